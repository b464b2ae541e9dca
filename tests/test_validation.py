"""Replies against the whole schema: each kind of issue, its path, and the order of issues."""

import copy
import json

from pyspark.sql import functions as F

from tallystone.operators import validation as V

GOOD = {
    "contractType": "lease", "contractSummary": "s", "contractSummarySimple": "s", "parties": [{"role": "r", "name": None, "identifier": "i", "notes": None}],
    "financialObligations": [], "dates": [{"label": "l", "date": None, "notes": None}], "penalties": [], "fees": [{"description": "d", "amount": 1, "currency": None, "isRecurring": None}],
    "importantClauses": [{"title": "t", "summary": "s", "riskLevel": None, "evidence": "the fox", "plainExplanation": "p"}], "extractedNumbers": [{"label": "l", "value": 1.5, "unit": None}],
    "missingInformation": [], "extractionNotes": None, "typeDetails": {"contractType": "lease", "propertyAddress": None, "monthlyRent": 3, "securityDeposit": None, "leaseTermMonths": 12, "renewalTerms": "r", "utilitiesIncluded": False},
}


def changed(**values):
    out = copy.deepcopy(GOOD)
    for name, value in values.items():
        if value is ...:
            del out[name]
        else:
            out[name] = value
    return out


def test_every_kind_of_issue(spark):
    clause = GOOD["importantClauses"][0]
    replies = [
        json.dumps(GOOD), "```JSON\n" + json.dumps(GOOD) + "\n```", None, " \n", "no {", "[]", "{}", json.dumps(changed(extra=1)),
        json.dumps(changed(contractSummary="x" * 501, parties=GOOD["parties"] * 7, fees=...)),
        json.dumps(changed(typeDetails={"contractType": "boat"}, contractType=None)), json.dumps(changed(typeDetails={**GOOD["typeDetails"], "contractType": "other"})),
        json.dumps(changed(importantClauses=[clause, {**clause, "evidence": "The fox"}, {**clause, "evidence": None, "riskLevel": "extreme"}])),
        json.dumps(changed(importantClauses=[clause, {**clause, "evidence": "The fox"}, {**clause, "evidence": "cat"}])),
        json.dumps(changed(extractedNumbers=[{"label": 1, "value": None, "unit": []}] * 5)), '{"contractType": "lease", "contractType": "other"}',
    ]
    frame = spark.createDataFrame([(i, r, "so the fox ran", "x") for i, r in enumerate(replies)], "i int, reply string, text string, status_ string").repartition(3)
    got = {r["i"]: (r["status"], r["n_issues"], r["issues"]) for r in V.validated_understandings(frame).collect()}
    assert got[0] == got[1] == got[7] == ("valid", 0, None)
    assert got[2] == got[3] == ("no_response", 0, None) and got[4] == got[14] == ("unreadable", 0, None)
    assert got[5] == ("invalid", 1, "- (root): Invalid input: expected object, received array")
    assert got[6][1] == 13 and got[6][2].endswith("\n...and 3 more issue(s).") and got[6][2].count("received undefined") == 9
    assert got[8] == ("invalid", 3, "- contractSummary: Too big: expected string to have <=500 characters\n- parties: Too big: expected array to have <=6 items\n- fees: Invalid input: expected array, received undefined")
    kinds = "|".join(f'"{k}"' for k in (*V.DETAILS, "other"))
    assert got[9][2] == f"- contractType: Invalid option: expected one of {kinds}\n- typeDetails.contractType: Invalid input"
    assert got[10] == ("invalid", 1, "- typeDetails.description: Invalid input: expected string, received undefined")
    assert got[11] == ("invalid", 1, '- importantClauses.2.riskLevel: Invalid option: expected one of "low"|"medium"|"high"')
    assert got[12] == ("unverified", 2, "\n".join(f"- importantClauses.{i}.evidence: {V.LOST_EVIDENCE}" for i in (1, 2)))
    assert got[13][1] == 15 and got[13][2].splitlines()[:3] == ["- extractedNumbers.0.label: Invalid input: expected string, received number", "- extractedNumbers.0.value: Invalid input: expected number, received null", "- extractedNumbers.0.unit: Invalid input: expected string, received array"]
    assert V.validated_understandings(frame.limit(0)).count() == 0


def test_kinds_of_values(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": 1.5e300, "c": true, "d": null, "e": [], "f": {}, "g": "x"}',)], "j string").withColumn("v", F.parse_json("j"))
    found = rows.select(*[V.kind_of(F.try_variant_get("v", F.lit(f"$.{c}"), "variant")).alias(c) for c in "abcdefgh"]).first()
    assert list(found) == ["number", "number", "boolean", "null", "array", "object", "string", "undefined"]
