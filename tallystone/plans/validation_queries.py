"""Replies composed from conversations and checked against the whole schema, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallystone.operators import validation as V
from tallystone.plans.document_queries import _view

_SAMPLE = {"string": '"said"', "number": "12.5", "boolean": "true", "array": '["war"]'}
_DETAILS = {kind: "{" + ", ".join([f'"contractType": "{kind}"', *(f'"{n}": {_SAMPLE[r.kind]}' for n, r in fields.items())]) + "}" for kind, fields in V.TYPED.items()}
_KINDS = ", ".join(f"'{k}'" for k in _DETAILS)
_PLANTED = "(conv_id * 3 + turn) % 18"
#: Replies of 18 kinds, in SQL of both engines; words of the text are quoted as evidence.
REPLIES = f"""SELECT conv_id, turn, text, CASE {_PLANTED} WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || j || chr(10) || '```' WHEN 11 THEN 'no answer {{' WHEN 12 THEN '  ' WHEN 14 THEN '{{}}' WHEN 15 THEN '[1, 2]' WHEN 16 THEN NULL ELSE j END AS reply FROM (
SELECT conv_id, turn, text, concat('{{"contractType": ', CASE {_PLANTED} WHEN 7 THEN '"boat"' WHEN 8 THEN '7' ELSE '"' || kind || '"' END,
  ', "contractSummary": "', repeat('s', CASE {_PLANTED} WHEN 2 THEN 501 ELSE 500 END), '", "contractSummarySimple": "é", ', CASE {_PLANTED} WHEN 4 THEN '"parties": "all"' WHEN 5 THEN concat('"parties": [', repeat('{{"role": "r", "name": null, "identifier": null, "notes": null}}, ', 6), '{{"role": 5, "identifier": true, "notes": null}}]') ELSE '"parties": []' END,
  ', "financialObligations": [{{"description": "Rent", "amount": ', CASE {_PLANTED} WHEN 6 THEN '"150"' ELSE '150' END, ', "currency": "SAR", "frequency": null, "dueDate": null}}], "dates": [], "penalties": [', CASE {_PLANTED} WHEN 6 THEN 'null, 3' ELSE '' END, ']',
  CASE {_PLANTED} WHEN 3 THEN '' ELSE ', "fees": [{{"description": "f", "amount": null, "currency": null, "isRecurring": false}}]' END,
  ', "importantClauses": [{{"title": "a", "summary": "b", "riskLevel": ', CASE {_PLANTED} WHEN 7 THEN '"extreme"' WHEN 1 THEN 'null' ELSE '"high"' END, ', "evidence": "', CASE WHEN conv_id % 4 = 0 THEN 'Never said' ELSE words END, '", "plainExplanation": "c"}}, {{"title": "d", "summary": "e", "riskLevel": "low", "evidence": null, "plainExplanation": "f"}}',
  CASE WHEN {_PLANTED} = 13 THEN repeat(', {{"title": "a", "summary": "b", "riskLevel": null, "evidence": "Nor this", "plainExplanation": "c"}}', 12) ELSE '' END, '], "extractedNumbers": [',
  CASE {_PLANTED} WHEN 10 THEN concat(repeat('{{"label": "n", "unit": "x"}}, ', 24), '{{"label": "n", "value": 1, "unit": "x"}}') ELSE '' END, '], "missingInformation": [{{"field": "x", "reason": null}}], "extractionNotes": null, "typeDetails": ',
  CASE {_PLANTED} WHEN 8 THEN '{{"contractType": "boat"}}' WHEN 9 THEN '[]' WHEN 17 THEN '{{"contractType": "insurance", "exclusions": [1, "b", null], "deductible": "none"}}' ELSE CASE kind {' '.join(f"WHEN '{k}' THEN '{v.replace('{', '{{').replace('}', '}}')}'" for k, v in _DETAILS.items())} END END, '}}') AS j
FROM (SELECT conv_id, turn, text, regexp_extract(text, '[A-Za-z]+( [A-Za-z]+)*', 0) AS words, KIND AS kind FROM conversations))""".replace("{{", "{").replace("}}", "}")
_PICK = f"(conv_id + turn) % {len(_DETAILS)}"


def validated_understandings(spark: SparkSession, d: str) -> DataFrame:
    rows = _view(spark, d, REPLIES.replace("KIND", f"element_at(array({_KINDS}), CAST({_PICK} AS INT) + 1)"), "conversations")
    return V.validated_understandings(rows).select("conv_id", "turn", "status", "n_issues", "issues")


def _issues_sql(j: str, rule: V.Rule, path: str, depth: int = 0) -> str:
    """The same walk over DuckDB's JSON: a list of lines."""
    kind = f"(CASE json_type({j}) WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE CASE WHEN {j} IS NULL THEN 'undefined' ELSE 'number' END END)"
    none, said = "[]::VARCHAR[]", f"({j} ->> '$')"
    line = lambda message, at=path: f"['- ' || {at} || ': ' || {message}]"
    under = lambda name: f"'{name}'" if path == "'(root)'" else f"{path} || '.{name}'"
    null = f"{kind} = 'null'" if rule.nullable else "false"
    if rule.kind in ("choice", "literal"):
        told = "|".join(f'"{v}"' for v in rule.values)
        text = f"'Invalid option: expected one of {told}'" if rule.kind == "choice" else f"'Invalid input: expected {told}'"
        among = ", ".join(f"'{v}'" for v in rule.values)
        return f"CASE WHEN {null} OR ({kind} = 'string' AND {said} IN ({among})) THEN {none} ELSE {line(text)} END"
    expected = "object" if rule.kind == "tagged" else rule.kind
    if rule.kind == "array":
        x, i = f"x{depth}", f"i{depth}"
        items = f"json_extract({j}, '$[*]')"
        found = f"flatten(list_transform({items}, lambda {x}, {i}: {_issues_sql(x, rule.item, f'{path} || {chr(39)}.{chr(39)} || ({i} - 1)', depth + 1)}))"
        if rule.most is not None:
            found += f" || CASE WHEN json_array_length({j}) > {rule.most} THEN {line(f'{chr(39)}Too big: expected array to have <={rule.most} items{chr(39)}')} ELSE {none} END"
    elif rule.kind == "object":
        found = " || ".join(_issues_sql(f"json_extract({j}, '$.{n}')", r, under(n), depth) for n, r in rule.fields.items())
    elif rule.kind == "tagged":
        tag = f"json_extract({j}, '$.{rule.tag}')"
        cases = " ".join(f"WHEN json_type({tag}) = 'VARCHAR' AND ({tag} ->> '$') = '{n}' THEN {_issues_sql(j, r, path, depth)}" for n, r in rule.fields.items())
        wrong = line("'Invalid input'", under(rule.tag))
        found = f"CASE {cases} ELSE {wrong} END"
    elif rule.kind == "string" and rule.most is not None:
        found = f"CASE WHEN length({said}) > {rule.most} THEN {line(f'{chr(39)}Too big: expected string to have <={rule.most} characters{chr(39)}')} ELSE {none} END"
    else:
        found = none
    received = f"'Invalid input: expected {expected}, received ' || {kind}"
    return f"CASE WHEN {null} THEN {none} WHEN {kind} = '{expected}' THEN {found} ELSE {line(received)} END"


def _sql() -> str:
    fence = r"'(?is)```(?:json)?\s*(.*?)\s*```'"
    return f"""WITH r AS ({REPLIES.replace("KIND", f"([{_KINDS}])[CAST({_PICK} AS INTEGER) + 1]")}),
b AS (SELECT *, trim(coalesce(CASE WHEN regexp_matches(reply, {fence}) THEN regexp_extract(reply, {fence}, 1) ELSE reply END, '')) AS body FROM r),
v AS (SELECT *, CASE WHEN body <> '' AND json_valid(body) THEN body::JSON END AS j FROM b),
i AS (SELECT *, CASE WHEN j IS NOT NULL THEN {_issues_sql("j", V.UNDERSTANDING, "'(root)'")} END AS found FROM v),
e AS (SELECT *, CASE WHEN len(found) = 0 THEN list_filter(list_transform(CAST(json_extract(j, '$.importantClauses') AS JSON[]), lambda c, n: CASE WHEN (c ->> '$.evidence') IS NOT NULL AND NOT contains(text, c ->> '$.evidence') THEN '- importantClauses.' || (n - 1) || '.evidence: {V.LOST_EVIDENCE}' END), lambda l: l IS NOT NULL) END AS lost FROM i),
s AS (SELECT *, CASE WHEN trim(coalesce(reply, '')) = '' THEN 'no_response' WHEN j IS NULL THEN 'unreadable' WHEN len(found) > 0 THEN 'invalid' WHEN len(lost) > 0 THEN 'unverified' ELSE 'valid' END AS status FROM e)
SELECT conv_id, turn, status, CAST(CASE WHEN status = 'unverified' THEN len(lost) ELSE coalesce(len(found), 0) END AS INTEGER) AS n_issues,
  CASE status WHEN 'unverified' THEN array_to_string(lost, chr(10)) WHEN 'invalid' THEN array_to_string(found[1:10], chr(10)) || CASE WHEN len(found) > 10 THEN chr(10) || '...and ' || (len(found) - 10) || ' more issue(s).' ELSE '' END END AS issues FROM s"""


def queries() -> dict:
    return {"validated_understandings": validated_understandings}


def oracle_sql() -> dict[str, str]:
    return {"validated_understandings": _sql()}
