"""The phrases that the rules look for.

Matched as substrings of normalised text; where several lists apply, the order given decides.
"""

# What a question asks for.
ASKS_CONTRACT_OWNERSHIP = (
    "عقدي", "في عقدي", "بعقدي", "حسب عقدي", "وفق عقدي", "هذا العقد", "العقد الخاص بي", "حسب الملف",
    "حسب العقد", "في العقد", "في الملف", "my contract", "this contract", "the contract", "in my contract",
    "according to my contract", "according to the contract", "according to the document", "in the document",
    "in my file", "per my contract",
)
ASKS_CONTRACT_STRUCTURE = (
    "بند", "البند", "الشرط الجزائي في عقدي", "فسخ العقد", "الإنهاء المبكر", "إنهاء العقد", "الطرف الآخر",
    "الأطراف", "الالتزام", "الالتزامات", "مدة العقد", "كم مدة العقد", "تاريخ التوقيع", "مستأجر", "مؤجر",
    "صاحب العمل", "مؤمن له", "مؤمن", "التأخر في السداد", "التأخر بالسداد", "التأخير في الدفع", "عدم السداد",
    "نهاية العقد", "تاريخ نهاية العقد", "تاريخ انتهاء العقد", "انتهاء العقد", "متى ينتهي العقد", "متى ينتهي",
    "متى نهاية العقد", "آخر قسط", "تاريخ آخر قسط", "بداية العقد", "تاريخ بداية العقد", "متى يبدأ العقد",
    "أول قسط", "تاريخ أول قسط", "clause", "this clause", "section", "termination", "early termination",
    "obligation", "party", "parties", "penalty", "this penalty", "payment terms", "contract duration",
    "how long is the contract", "signature date", "tenant", "landlord", "employer", "insured", "insurer",
    "late payment", "contract end date", "contract expiry date", "when does the contract end",
    "when does the contract expire", "end of the contract", "expiry of the contract", "last installment date",
    "final payment date", "first installment date", "contract start date", "when does the contract start",
)
ASKS_FINANCIAL_TERM = (
    "شهريا", "كل شهر", "القسط", "الأقساط", "الإجمالي", "التكلفة الإجمالية", "سنويا", "الرسوم", "رسوم التأخير",
    "رسوم التأخر", "النسبة", "معدل الفائدة", "الفائدة", "كم المبلغ", "كم سأدفع", "كم يجب أن أدفع",
    "monthly payment", "every month", "per month", "installment", "total cost", "total amount",
    "annual commitment", "yearly", "late fee", "late fees", "percentage", "interest rate", "apr", "exposure",
    "how much will i pay", "how much do i pay", "ratio",
)
ASKS_FINANCIAL_COMPUTE_TRIGGER = (
    "كم", "احسب", "how much", "calculate",
)
ASKS_LEGAL_TERM = (
    "نظاميا", "الأنظمة السعودية", "نظام العمل", "نظام الإيجار", "اللائحة", "لائحة", "بموجب النظام",
    "وفقا للنظام", "يخالف النظام", "مسموح قانونيا", "قانوني", "غير قانوني", "ساما", "saudi law",
    "saudi regulation", "saudi regulations", "under saudi law", "under the law", "applicable law",
    "the law says", "governed by law", "regulation", "regulatory", "is this legal", "is it legal",
    "allowed under", "permitted under", "sama", "official limit", "maximum allowed by law",
)
ASKS_COMPARISON_ACTOR = (
    "مؤجر", "بنك", "شركة", "مؤمن", "جهة التمويل", "صاحب العمل", "الطرف الآخر", "the landlord", "the lender",
    "the bank", "the insurer", "the company", "the employer", "the other party",
)
ASKS_COMPARISON_ACTION_STEM = (
    "إخلا", "فسخ", "إنها", "خصم", "رفض", "إلغا", "زياد", "evict", "terminate", "cancel", "deduct", "reject",
    "increase the rent",
)
ASKS_RIGHTS_QUESTION = (
    "هل يحق", "هل من حق", "هل يجوز لـ", "ما حقوقي", "حقوقي بخصوص", "is this allowed", "am i entitled",
    "what are my rights", "is it permitted",
)
ASKS_COMPARISON_EXPLICIT = (
    "قارن", "مقارنة", "يتوافق مع النظام", "مطابق للنظام", "compare this", "compare the", "does this comply",
    "complies with the law",
)
ASKS_DEFINITIONAL = (
    "ما معنى", "ما هو مفهوم", "عرف لي", "what does", "what is a", "define",
)
ASKS_INJECTION = (
    "تجاهل التعليمات", "تجاهل العقد", "اكشف عن جميع", "عقود المستخدمين الآخرين", "تجاوز التعليمات",
    "ignore the contract", "ignore previous instructions", "ignore all previous", "reveal all",
    "other users' contracts", "other users contracts", "all other users", "system prompt", "bypass",
    "disregard your instructions",
)

# Kinds of obligations, fees and penalties, first match wins.
OBLIGATION_TYPES = {
    "principal": ("principal", "financed amount", "loan amount", "amount financed", "opening financed balance", "opening balance", "أصل المبلغ", "المبلغ الممول", "مبلغ التمويل", "الرصيد الممول الافتتاحي", "الرصيد الافتتاحي",),
    "balloon_payment": ("balloon", "final payment", "residual value", "دفعة ختامية", "القيمة المتبقية",),
    "deposit": ("deposit", "security deposit", "تأمين", "وديعة", "عربون",),
    "upfront_payment": ("down payment", "downpayment", "upfront", "initial payment", "دفعة أولى", "دفعة مقدمة",),
    "insurance": ("insurance", "premium", "تأمين", "قسط التأمين",),
    "tax": ("tax", "vat", "ضريبة",),
    "conditional_payment": ("penalty", "late fee", "if applicable", "conditional", "غرامة", "شرط",),
}
FEE_TYPES = {
    "administration": ("administration", "admin fee", "رسوم إدارية",),
    "processing": ("processing", "handling", "رسوم معالجة",),
    "subscription": ("subscription", "membership", "اشتراك",),
    "insurance": ("insurance", "premium", "تأمين",),
    "maintenance": ("maintenance", "صيانة",),
    "transfer": ("transfer", "تحويل",),
    "registration": ("registration", "تسجيل",),
    "service": ("service fee", "خدمة",),
    "renewal": ("renewal", "تجديد",),
    "tax": ("tax", "vat", "ضريبة",),
}
PENALTY_TYPES = {
    "late_payment": ("late payment", "late fee", "overdue", "تأخير السداد", "دفع متأخر",),
    "early_termination": ("early termination", "termination fee", "إنهاء مبكر",),
    "early_settlement": ("early settlement", "early repayment", "سداد مبكر",),
    "default": ("default", "breach", "إخلال",),
    "cancellation": ("cancellation", "إلغاء",),
    "returned_payment": ("returned payment", "bounced", "نسخ مرتجع", "شيك مرتجع",),
}
FREQUENCIES = {
    "daily": ("daily", "per day", "يوميا", "يومي",),
    "weekly": ("weekly", "per week", "أسبوعيا", "أسبوعي",),
    "monthly": ("monthly", "per month", "شهريا", "شهري", "شهريًا",),
    "quarterly": ("quarterly", "every quarter", "ربع سنوي", "ربعي", "كل ثلاثة أشهر",),
    "semi_annual": ("semi-annual", "semiannual", "twice a year", "نصف سنوي", "كل ستة أشهر",),
    "annual": ("annual", "yearly", "per year", "سنويا", "سنوي", "سنويًا",),
    "one_time": ("one time", "one-time", "single payment", "upfront", "دفعة واحدة", "لمرة واحدة",),
    "irregular": ("irregular", "as needed", "variable", "غير منتظم",),
}

# What a description says of an amount.
SAYS_MANDATORY = (
    "mandatory", "required", "must pay", "إلزامي", "واجب",
)
SAYS_OPTIONAL = (
    "optional", "voluntary", "if elected", "اختياري",
)
SAYS_CONDITIONAL = (
    "if", "in case", "should", "unless", "penalty", "late", "default", "cancellation", "early termination",
    "termination fee", "may apply", "in the event of", "when applicable", "as applicable", "if applicable",
    "where applicable", "as needed", "when necessary", "subject to", "contingent on", "contingent upon",
    "depending on", "capped at", "up to a maximum", "not to exceed", "no more than", "up to", "إذا", "في حال",
    "غرامة", "تأخير", "إنهاء مبكر", "إنهاء العقد", "عند الاقتضاء", "حسب الحالة", "عند الحاجة", "حسب الحاجة",
    "بحسب الحاجة", "بحد أقصى", "لا يتجاوز", "حتى",
)
SAYS_DUE_LATER = (
    "at the end of the term", "at the end of the contract", "at the end of the lease", "upon renewal",
    "at renewal", "after the first year", "at maturity", "upon expiry", "at contract end", "final payment",
    "balloon payment", "residual value", "عند انتهاء العقد", "عند نهاية العقد", "عند التجديد",
    "بعد السنة الأولى", "في نهاية المدة", "الدفعة الختامية", "الدفعة الأخيرة", "القيمة المتبقية",
)
SAYS_DUE_NOW = (
    "at signing", "upon signing", "at the signing", "at contract signing", "at contract start",
    "at the start of the contract", "due at signing", "payable at signing", "due now", "immediately due",
    "due immediately", "at closing", "at inception", "upon execution", "at activation", "upon activation",
    "at policy start", "upon policy issuance", "at the outset", "عند التوقيع", "عند توقيع العقد",
    "عند بدء العقد", "عند إبرام العقد", "فور التوقيع", "عند التفعيل", "عند بداية العقد", "عند إصدار الوثيقة",
    "عند بدء التغطية",
)
SAYS_REFUNDABLE = (
    "refundable", "returned at the end", "قابل للاسترداد", "يسترد",
)
SAYS_NON_REFUNDABLE = (
    "non-refundable", "nonrefundable", "not refundable", "غير قابل للاسترداد",
)
SAYS_TOTAL_COST = (
    "total cost", "total amount", "total repayment", "total payable", "grand total", "total of payments",
    "total payments", "total installments", "total instalments", "إجمالي التكلفة", "المبلغ الإجمالي",
    "إجمالي المبلغ", "إجمالي الدفعات", "إجمالي الأقساط",
)
SAYS_DUE_AT_SIGNING_TOTAL = (
    "due at signing", "total due at signing", "amount due at signing", "payable at signing",
    "total payable at signing", "cash due at signing", "due at lease signing", "total amount due at signing",
    "due at contract signing", "total due at contract signing", "المبلغ المستحق عند التوقيع",
    "الإجمالي المستحق عند التوقيع", "إجمالي المستحق عند التوقيع", "المبلغ الإجمالي المستحق عند التوقيع",
    "المستحق عند توقيع العقد", "إجمالي المبلغ المستحق عند التوقيع",
)
SAYS_COMPENSATION_COMPONENT = (
    "housing allowance", "accommodation allowance", "transportation allowance", "transport allowance",
    "cost of living allowance", "fixed allowance", "guaranteed allowance", "monthly allowance", "بدل سكن",
    "بدل السكن", "بدل نقل", "بدل النقل", "بدل مواصلات", "بدل ثابت", "بدل شهري",
)
SAYS_STATED_TOTAL_COMPENSATION = (
    "total fixed monthly compensation", "total fixed compensation", "total monthly compensation",
    "total guaranteed compensation", "gross fixed monthly salary", "total fixed salary",
    "إجمالي الراتب الثابت الشهري", "إجمالي التعويض الثابت", "إجمالي الأجر الثابت الشهري",
    "إجمالي الراتب الشهري الثابت",
)
SAYS_CONDITIONAL_COMPENSATION = (
    "performance bonus", "discretionary bonus", "annual bonus", "incentive bonus", "commission",
    "overtime pay", "overtime compensation", "variable pay", "profit share", "profit-sharing",
    "مكافأة الأداء", "مكافأة تقديرية", "مكافأة سنوية", "عمولة", "أجر إضافي", "بدل ساعات إضافية",
    "مكافأة تحفيزية",
)
SAYS_NON_CASH_BENEFIT = (
    "medical insurance", "health insurance", "annual leave", "paid leave", "overtime entitlement",
    "non-cash benefit", "in-kind benefit", "end of service", "end-of-service", "gratuity", "تأمين طبي",
    "تأمين صحي", "إجازة سنوية", "إجازة مدفوعة", "استحقاق العمل الإضافي", "مزايا عينية", "مكافأة نهاية الخدمة",
)
SAYS_EMPLOYEE_ENTITLEMENT = (
    "entitled to compensation", "employee shall be entitled", "payable to the employee",
    "compensation to the employee", "compensation payable to the employee", "without a legitimate reason",
    "without legitimate reason", "without just cause", "without a just cause", "unjustified termination",
    "unjustified dismissal", "arbitrary dismissal", "يستحق الموظف", "تعويض للموظف", "يحق للموظف",
    "دون سبب مشروع", "دون مبرر مشروع", "بدون سبب مشروع", "فصل تعسفي", "إنهاء تعسفي",
)
SAYS_DEPOSIT = (
    "deposit", "security deposit", "تأمين", "وديعة", "عربون",
)
SAYS_DURATION_UNIT = (
    "day", "days", "month", "months", "year", "years", "يوم", "أيام", "شهر", "أشهر", "سنة", "سنوات",
)
SAYS_ASSET_VALUE = (
    "vehicle value", "asset value", "vehicle price", "purchase price", "asset price", "cash price",
    "list price", "sale price", "contract price", "sticker price", "market value", "property value",
    "cash value", "insured value", "sum insured", "stated value", "declared value", "قيمة المركبة",
    "سعر المركبة", "قيمة العقار", "سعر الشراء", "قيمة الأصل", "السعر النقدي", "سعر البيع", "القيمة السوقية",
    "القيمة النقدية", "المبلغ المؤمن عليه",
)
SAYS_EARLY_SETTLEMENT_BALANCE = (
    "remaining balance", "outstanding balance", "remaining payments", "الرصيد المتبقي",
    "عدد الدفعات المتبقية",
)
SAYS_EARLY_SETTLEMENT_PAYMENT = (
    "early settlement", "early repayment", "early-settlement total", "settlement amount", "settlement total",
    "term cost", "three-month", "السداد المبكر", "التسوية المبكرة", "إجمالي التسوية المبكرة", "كلفة الأجل",
)
SAYS_DEFAULT_SCENARIO = (
    "upon default", "in the event of default", "عند التعثر", "في حال الإخلال",
)
SAYS_CANCELLATION_SCENARIO = (
    "upon cancellation", "if cancelled", "عند الإلغاء", "في حال الإلغاء",
)
SAYS_INSURANCE_CLAIM = (
    "insurance claim", "in the event of a claim", "مطالبة تأمين", "عند المطالبة",
)

# Names of currencies.
CURRENCY_NAMES = {
    "sar": "SAR",
    "sr": "SAR",
    "saudi riyal": "SAR",
    "saudi riyals": "SAR",
    "ريال": "SAR",
    "ريال سعودي": "SAR",
    "ر.س": "SAR",
    "usd": "USD",
    "$": "USD",
    "us dollar": "USD",
    "us dollars": "USD",
    "دولار": "USD",
    "eur": "EUR",
    "€": "EUR",
    "euro": "EUR",
    "يورو": "EUR",
    "gbp": "GBP",
    "£": "GBP",
    "pound": "GBP",
    "aed": "AED",
    "درهم": "AED",
}

# Concepts that a clause can state: the title of its own, then its key phrases.
CLAUSE_ANCHORS = {
    "late_payment": ("التأخر في السداد", "التأخر في السداد", "التأخر عن سداد", "التأخير في الدفع", "late payment", "overdue payment", "payment delay"),
    "collection_cost": ("تكاليف التحصيل", "تكاليف التحصيل", "رسوم التحصيل", "تكلفة التحصيل", "collection cost", "collection fee", "collection charges"),
    "early_settlement": ("السداد المبكر", "السداد المبكر", "التسوية المبكرة", "الوفاء المبكر", "early settlement", "early repayment", "early payoff"),
    "ownership": ("ملكية الأصل", "ملكية المركبة", "ملكية العقار", "تسجيل المركبة", "تبقى المركبة مسجلة", "vehicle ownership", "title to the vehicle", "remains registered"),
    "insurance_first_year": ("التأمين للسنة الأولى", "للسنة الأولى", "السنة الأولى فقط", "first year only", "for the first year", "included for the first year", "first-year insurance"),
    "insurance_renewal": ("تجديد التأمين للسنوات اللاحقة", "تجديد التأمين", "السنوات اللاحقة", "السنوات التالية", "insurance renewal", "renewal for subsequent years", "later years", "subsequent years"),
    "automatic_renewal": ("التجديد التلقائي", "التجديد التلقائي", "يتجدد العقد تلقائيا", "يتجدد تلقائيا", "renewed automatically", "automatic renewal", "auto-renewal", "auto renewal"),
    "cancellation": ("إلغاء الاشتراك", "إلغاء الاشتراك", "إلغاء العقد", "الإلغاء قبل", "cancel the subscription", "cancellation of the agreement", "cancel this agreement"),
    "termination_notice": ("إشعار إنهاء العقد", "إشعار إنهاء العقد", "إشعار بالإنهاء", "مهلة الإخطار بالإنهاء", "termination notice", "notice of termination", "notice period for termination"),
    "termination_fee": ("رسوم إنهاء العقد", "رسوم إنهاء العقد", "غرامة الإنهاء", "غرامة الإنهاء المبكر", "termination fee", "early termination fee", "termination penalty"),
    "maintenance_duty": ("الالتزام بالصيانة", "الالتزام بالصيانة", "أعمال الصيانة الدورية", "مسؤولية الصيانة", "maintenance obligation", "routine maintenance duty", "responsible for maintenance"),
    "damage_compensation": ("التعويض عن الأضرار", "التعويض عن الأضرار", "تعويض عن التلف", "تعويض عن الضرر", "compensation for damage", "damages compensation", "compensate for any damage"),
}

# From special keys to the public types of informational amounts.
INFORMATIONAL_TYPES = {
    "principal": "principal", "creditLimit": "credit_limit", "outstandingBalance": "outstanding_balance", "monthlyIncome": "monthly_income", "statedTotalCost": "stated_total_cost",
    "insuranceDeductible": "insurance_deductible", "coverageAmount": "coverage_amount", "rate": "rate", "recurringEquivalent": "annual_equivalent", "statedDueAtSigning": "stated_due_at_signing",
    "salaryComponent": "salary_component", "statedTotalCompensation": "total_fixed_compensation",
}
# Concepts by the type of an item, by source.
TYPE_CONCEPTS = {
    "informational": {
        "principal": "financing_principal", "credit_limit": "credit_limit", "coverage_amount": "coverage_limit", "insurance_deductible": "deductible", "monthly_income": "salary", "rate": "interest_rate",
        "asset_value": "asset_value", "annual_equivalent": "annual_rent",
    },
    "obligation": {"upfront_payment": "down_payment", "deposit": "security_deposit", "insurance": "insurance_premium", "tax": "tax", "balloon_payment": "final_payment"},
    "fee": {
        "administration": "administrative_fee", "processing": "processing_fee", "subscription": "subscription_fee", "insurance": "insurance_premium", "maintenance": "maintenance_cost", "transfer": "transfer_fee",
        "registration": "registration_fee", "service": "service_fee", "renewal": "renewal_cost", "tax": "tax",
    },
    "penalty": {"late_payment": "late_fee", "early_termination": "early_termination_fee", "early_settlement": "early_settlement_fee", "default": "collection_cost", "cancellation": "cancellation_fee", "returned_payment": "returned_payment_fee"},
}
# Concepts by words of a label, in the order in which they claim it.
LABEL_CONCEPTS = {
    "administrative_fee": ("administrative", "admin fee", "إداري", "رسوم إدارية"),
    "brokerage_fee": ("brokerage", "broker", "وساطة", "سمسرة"),
    "financing_cost": ("financing cost", "cost of financing", "تكلفة التمويل"),
    "final_payment": ("final payment", "balloon", "residual value", "دفعة ختامية", "القيمة المتبقية"),
    "monthly_rent": ("rent", "إيجار"),
    "salary": ("salary", "wage", "راتب", "أجر"),
    "allowance": ("allowance", "بدل"),
    "bonus": ("bonus", "مكافأة"),
    "late_fee": ("late", "overdue", "تأخير"),
    "early_termination_fee": ("early termination", "termination fee", "إنهاء مبكر", "إنهاء العقد"),
    "early_settlement_fee": ("early settlement", "early repayment", "سداد مبكر", "التسوية المبكرة"),
    "collection_cost": ("collection", "تحصيل"),
    "cancellation_fee": ("cancellation", "إلغاء"),
    "returned_payment_fee": ("returned payment", "bounced", "شيك مرتجع"),
}
# What recurs in a contract of a type, and concepts by role.
RECURRING_CONCEPTS = {
    "auto_finance": "monthly_installment", "personal_finance": "monthly_installment", "mortgage": "monthly_installment", "subscription": "subscription_fee", "credit_card": "minimum_payment", "employment": "salary",
    "insurance": "insurance_premium",
}
ROLE_CONCEPTS = {
    "one_time_outflow": "one_time_payment", "upfront_liquidity": "one_time_payment", "refundable": "security_deposit", "credit_limit": "credit_limit", "coverage_limit": "coverage_limit",
    "financing_principal": "financing_principal", "asset_value": "asset_value", "income": "salary", "refund": "refund",
}
# Roles that are never due, concepts that are fees, and words that state a cap.
INFORMATIONAL_ROLES = ("income", "credit_limit", "coverage_limit", "asset_value", "benefit", "refund", "rate_or_percentage", "informational_total", "financing_principal", "deduction")
FEE_LIKE_CONCEPTS = (
    "administrative_fee", "processing_fee", "brokerage_fee", "service_fee", "maintenance_cost", "renewal_cost", "registration_fee", "transfer_fee", "subscription_fee", "annual_fee", "insurance_premium", "financing_cost",
)
SAYS_STATED_CAP = ("up to", "maximum", "capped at", "not exceeding", "no more than", "حتى", "بحد أقصى", "لا يتجاوز")
# Headline figures in order; "duration" is the contract's own.
KEY_FIGURES = (
    "monthly_installment", "monthly_rent", "duration", "down_payment", "total_repayment", "final_payment", "financing_principal", "interest_rate", "salary", "credit_limit", "security_deposit", "insurance_premium",
    "minimum_payment", "annual_fee", "subscription_fee", "administrative_fee", "brokerage_fee",
)

# Arabic number words as ``lookup_form`` writes them; a thousand multiplies what stands before it.
NUMBER_WORDS = {
    "صفر": 0, "واحد": 1, "احد": 1, "اثنان": 2, "اثنين": 2, "ثلاثه": 3, "اربعه": 4, "خمسه": 5, "سته": 6, "سبعه": 7, "ثمانيه": 8, "تسعه": 9, "عشر": 10, "عشره": 10,
    "عشرون": 20, "عشرين": 20, "ثلاثون": 30, "ثلاثين": 30, "اربعون": 40, "اربعين": 40, "خمسون": 50, "خمسين": 50, "ستون": 60, "ستين": 60, "سبعون": 70, "سبعين": 70, "ثمانون": 80, "ثمانين": 80, "تسعون": 90, "تسعين": 90,
    "مايه": 100, "ميه": 100, "مايتان": 200, "ميتان": 200, "مايتين": 200, "ميتين": 200, "ثلاثمايه": 300, "ثلاثميه": 300, "اربعمايه": 400, "اربعميه": 400, "خمسمايه": 500, "خمسميه": 500,
    "ستمايه": 600, "ستميه": 600, "سبعمايه": 700, "سبعميه": 700, "ثمانمايه": 800, "ثمانميه": 800, "تسعمايه": 900, "تسعميه": 900,
}
TWO_THOUSAND = ("الفان", "الفين")
THOUSAND = ("الف", "الفا", "الاف")
PERCENT_WORDS = ("بالمايه", "بالميه", "في المايه", "في الميه", "%", "٪")
# Figures of a financing agreement: unit, then labels in order of preference.
RECOVERED_FIELDS = {
    "cash_price": ("SAR", "السعر النقدي", "السعر الإجمالي", "cash price"),
    "down_payment": ("SAR", "الدفعة الأولى", "المقدم", "down payment"),
    "financed_amount": ("SAR", "أصل التمويل", "المبلغ الممول", "financed amount", "principal"),
    "profit_rate": ("percent", "نسبة الربح", "هامش التمويل", "profit rate"),
    "total_profit": ("SAR", "إجمالي الربح", "total profit"),
    "total_payable": ("SAR", "إجمالي المبلغ الواجب سداده", "total payable"),
    "term_months": ("months", "مدة التمويل", "financing term"),
    "installment": ("SAR", "قيمة القسط", "القسط الشهري", "monthly installment"),
}
UNIT_ENDS = {"SAR": "ريال", "percent": "بالمائة|بالمئة|في المائة|في المئة|%|٪", "months": "شهر"}
