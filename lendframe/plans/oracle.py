"""The same queries in ANSI SQL, for checking against another engine.

Written from the definitions, not from the Spark plans. Constants are doubles
(``0.6e0``), ties are broken explicitly, doubles are rounded to six places.
"""

from __future__ import annotations

from .. import vocabulary as v

SQL: dict[str, str] = {}


def clip(e: str, lo: float | None = None, hi: float | None = None) -> str:
    x = e
    if lo is not None:
        x = f"greatest({x}, {float(lo)!r}e0)"
    if hi is not None:
        x = f"least({x}, {float(hi)!r}e0)"
    return f"CASE WHEN {e} IS NOT NULL THEN {x} END"


def div(n: str, d: str, fill: str = "0e0") -> str:
    return f"coalesce(({n}) / nullif({d}, 0e0), {fill})"


def pick(n: str, *values: str | None) -> str:
    cases = " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(values) if x is not None)
    return f"CASE {n} {cases} END"


def in_list(values) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + ")"


def recode(c: str, table: dict) -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{float(x)!r}e0"
    return f"CASE {c} " + " ".join(f"WHEN {lit(k)} THEN {lit(x)}" for k, x in table.items()) + " END"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def with_(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body


# ---- shared views -----------------------------------------------------------------

APP = f"""app AS (
 SELECT o_orderkey AS application_id, o_custkey AS applicant_id, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'under_review' END AS status,
  CAST(18 + o_custkey % 63 AS DOUBLE) AS Age,
  round((c_acctbal + 1000e0) * 12e0, 2) AS Income, o_totalprice AS LoanAmount,
  CAST(300 + (o_orderkey * 7919) % 551 AS DOUBLE) AS CreditScore,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 241 AS DOUBLE) END AS MonthsEmployed,
  CAST(n_lines AS DOUBLE) AS NumCreditLines, CAST(o_custkey % 26 AS DOUBLE) AS InterestRate,
  CAST(12 * (1 + o_orderkey % 5) AS DOUBLE) AS LoanTerm, CAST(o_orderkey % 160 AS DOUBLE) / 100e0 AS DTIRatio,
  {pick('o_orderkey % 5', 'High School', "Bachelor's", "Master's", 'PhD', 'Kindergarten')} AS Education,
  {pick('o_custkey % 5', 'Full-time', 'Part-time', 'Self-employed', 'Unemployed', None)} AS EmploymentType,
  {pick('o_custkey % 4', 'Single', 'Married', 'Divorced', None)} AS MaritalStatus,
  {pick('o_orderkey % 2', 'Yes', 'No')} AS HasMortgage, {pick('o_custkey % 3', 'Yes', 'No', 'No')} AS HasDependents,
  {pick('o_orderkey % 6', 'Auto', 'Business', 'Education', 'Home', 'Other', 'Spaceship')} AS LoanPurpose,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Yes' ELSE 'No' END AS HasCoSigner,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "Default",
  CAST(o_orderkey % 1000 AS DOUBLE) / 1000e0 AS probability, o_orderpriority AS priority,
  c_mktsegment AS segment, c_nationkey AS nation
 FROM orders JOIN customer ON o_custkey = c_custkey
 LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def repaired(source: str, name: str = "rep", extra: str = "") -> str:
    nums = ", ".join(f"{clip(c, *b)} AS {c}" for c, b in v.NUMERIC_BOUNDS.items())
    cats = ", ".join(f"CASE WHEN {c} IN {in_list(x)} THEN {c} END AS {c}" for c, x in v.LEVELS.items())
    return f'{name} AS (SELECT application_id, applicant_id, ts, segment, probability, "Default", {nums}, {cats}{extra} FROM {source})'


def derived_ctes(source: str) -> str:
    growth = "pow(1e0 + r, t)"
    return f"""d0 AS (SELECT *, coalesce(LoanAmount, 0e0) AS p, coalesce(InterestRate, 0e0) / 100e0 / 12e0 AS r,
  greatest(coalesce(LoanTerm, 0e0), 1e0) AS t FROM {source}),
d1 AS (SELECT *, greatest(CASE WHEN r > 1e-9 THEN p * r * {growth} / ({growth} - 1e0) ELSE p / t END, 0e0) AS MonthlyInstalment,
  {clip("(0.6e0 * (1e0 - exp(-coalesce(MonthsEmployed, 0e0) / 36e0)) + 0.4e0 * coalesce(" + recode("EmploymentType", v.EMPLOYMENT_WEIGHT) + ", 0.5e0))", 0, 1)} AS EmploymentStabilityScore,
  CASE WHEN Age > 0 THEN CASE WHEN Age <= 25 THEN '18-25' WHEN Age <= 35 THEN '26-35' WHEN Age <= 50 THEN '36-50'
   WHEN Age <= 65 THEN '51-65' WHEN Age <= 200 THEN '65+' END END AS AgeGroup FROM d0),
der AS (SELECT *, {clip(div('LoanAmount', 'Income'), 0, 50)} AS LoanToIncomeRatio,
  {clip(div('MonthlyInstalment', 'Income / 12e0'), 0, 20)} AS InstalmentToIncomeRatio,
  {clip('(coalesce(DTIRatio, 0e0) + ' + clip(div('MonthlyInstalment', 'Income / 12e0'), 0, 20) + ')', 0, 20)} AS TotalDebtServiceRatio,
  {clip(div('DTIRatio', clip('NumCreditLines', 1)), 0, 5)} AS CreditUtilizationProxy,
  CASE WHEN CreditScore < 0 THEN NULL WHEN CreditScore < 500 THEN 0e0 WHEN CreditScore < 580 THEN 1e0 WHEN CreditScore < 670 THEN 2e0
   WHEN CreditScore < 740 THEN 3e0 WHEN CreditScore < 800 THEN 4e0 WHEN CreditScore < 900 THEN 5e0 END AS CreditScoreBandOrdinal,
  {recode('AgeGroup', v.AGE_RISK)} AS AgeRiskBand,
  coalesce(LoanAmount * InterestRate / 100e0, 0e0) AS InterestBurden,
  {clip(div('NumCreditLines', clip('(Age - 18e0)', 1)), 0, 5)} AS CreditLinesPerYearOfAge,
  CASE WHEN Income IS NULL THEN NULL WHEN Income <= 40000 THEN 'low' WHEN Income <= 75000 THEN 'lower-mid'
   WHEN Income <= 115000 THEN 'upper-mid' ELSE 'high' END AS IncomeQuartileBand,
  {clip('(0.4e0 * ' + clip('(1e0 - coalesce(NumCreditLines, 0e0) / 4e0)', 0, 1) + ' + 0.35e0 * '
        + clip('(1e0 - coalesce(MonthsEmployed, 0e0) / 120e0)', 0, 1) + ' + 0.25e0 * '
        + clip('((30e0 - coalesce(Age, 45e0)) / 12e0)', 0, 1) + ')', 0, 1)} AS ThinFileScore,
  {clip("(0.4e0 * CASE WHEN HasMortgage = 'Yes' THEN 1e0 ELSE 0e0 END + 0.35e0 * EmploymentStabilityScore + 0.25e0 * coalesce("
        + recode('Education', v.EDUCATION_RANK) + ", 1e0) / 3e0)", 0, 1)} AS AlternateDataScore,
  {clip("(0.45e0 * CASE WHEN HasCoSigner = 'Yes' THEN 1e0 ELSE 0e0 END + 0.35e0 * CASE WHEN LoanPurpose IN ('Home', 'Auto') THEN 1e0 ELSE 0e0 END"
        " + 0.2e0 * CASE WHEN HasMortgage = 'Yes' THEN 1e0 ELSE 0e0 END)", 0, 1)} AS CollateralSupportScore
 FROM d1)"""


def score(p: str) -> str:
    """0-100 score for cut points 0.05 and 0.30, to two places."""
    q = f"least(greatest({p}, 0e0), 1e0)"
    return (f"round_even(CASE WHEN {p} IS NULL THEN NULL WHEN {q} <= 0.05e0 THEN 25e0 * {q} / 0.05e0 "
            f"WHEN {q} <= 0.3e0 THEN 25e0 + 50e0 * ({q} - 0.05e0) / 0.25e0 "
            f"ELSE 75e0 + 25e0 * ({q} - 0.3e0) / 0.7e0 END, 2)")


def level(s: str) -> str:
    return f"CASE WHEN {s} IS NULL THEN NULL WHEN {s} < 25 THEN 'low' WHEN {s} >= 75 THEN 'high' ELSE 'medium' END"


CONF = "(0.55e0 + 0.25e0 * abs(probability - 0.5e0) * 2e0 + 0.2e0 * least(least(abs(probability - 0.05e0), abs(probability - 0.3e0)) / 0.15e0, 1e0))"


def scored(source: str, name: str = "sc") -> str:
    return (f"{name} AS (SELECT *, {level('risk_score')} AS risk_level, {CONF} AS confidence FROM "
            f"(SELECT *, {score('probability')} AS risk_score FROM {source}))")


def rules_cte(source: str, name: str = "fr") -> str:
    """Fraud columns over a source with the base columns."""
    rules = [
        ("INCOME_EMPLOYMENT_MISMATCH", 0.35, "job = 'Unemployed' AND inc > 75000",
         "'Declared income of ' || format('{:,}', CAST(round_even(inc, 0) AS BIGINT)) || ' is inconsistent with ''Unemployed'' employment status.'"),
        ("INCOME_EMPLOYMENT_MISMATCH", 0.20, "job = 'Part-time' AND inc > 120000",
         "'Declared income of ' || format('{:,}', CAST(round_even(inc, 0) AS BIGINT)) || ' is unusually high for part-time employment.'"),
        ("TENURE_EXCEEDS_AGE", 0.40, "mon > greatest((ag - 16e0) * 12e0, 0e0)",
         "'Employment tenure of ' || CAST(mon AS BIGINT) || ' months is impossible for an applicant aged ' || CAST(ag AS BIGINT) || '.'"),
        ("CREDIT_HISTORY_AGE_MISMATCH", 0.25, "ag < 22 AND ln >= 4",
         "CAST(ln AS BIGINT) || ' open credit lines is atypical for an applicant aged ' || CAST(ag AS BIGINT) || '.'"),
        ("CREDIT_SCORE_AGE_MISMATCH", 0.30, "ag < 21 AND cs > 780",
         "'A credit score of ' || CAST(cs AS BIGINT) || ' is not attainable with the credit history length available to an applicant aged ' || CAST(ag AS BIGINT) || '.'"),
        ("IMPLAUSIBLE_LOAN_TO_INCOME", 0.25, "inc > 0 AND loan / inc > 8",
         "'Requested amount is ' || printf('%.1f', loan / inc) || 'x declared annual income.'"),
        ("ZERO_INCOME_WITH_LOAN_REQUEST", 0.35, "inc <= 0 AND loan > 0", "'A loan is requested against zero declared income.'"),
        ("DTI_CREDIT_SCORE_CONTRADICTION", 0.20, "dti > 0.85e0 AND cs > 760",
         "'A debt-to-income ratio of ' || printf('%.2f', dti) || ' is not consistent with a credit score of ' || CAST(cs AS BIGINT) || '.'"),
        ("SCORE_WITHOUT_CREDIT_FILE", 0.25, "ln = 0 AND cs > 720",
         "'A credit score of ' || CAST(cs AS BIGINT) || ' is reported with no open credit lines.'"),
        ("SUSPICIOUSLY_ROUND_FIGURES", 0.10, "inc > 0 AND inc % 10000e0 = 0 AND loan > 0 AND loan % 10000e0 = 0",
         "'Both income and loan amount are exact multiples of 10,000.'"),
    ]
    miss = " * ".join(f"CASE WHEN {c} THEN 1e0 - {w!r}e0 ELSE 1e0 END" for _, w, c, _ in rules)
    codes = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c, _ in rules) + ")"
    reasons = "concat_ws(' ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for _, _, c, t in rules) + ")"
    return f"""{name}0 AS (SELECT *, coalesce(Age, 40e0) AS ag, coalesce(Income, 0e0) AS inc, coalesce(LoanAmount, 0e0) AS loan,
  coalesce(CreditScore, 600e0) AS cs, coalesce(MonthsEmployed, 0e0) AS mon, coalesce(NumCreditLines, 0e0) AS ln,
  coalesce(DTIRatio, 0e0) AS dti, coalesce(EmploymentType, '') AS job FROM {source}),
{name}1 AS (SELECT *, {miss} AS miss, {codes} AS codes, {reasons} AS reasons FROM {name}0),
{name} AS (SELECT *, fraud_probability >= 0.55 AS fraud_flag,
  CASE WHEN fraud_probability >= 0.55 THEN 'high' WHEN fraud_probability >= 0.25 THEN 'medium' ELSE 'low' END AS fraud_tier
 FROM (SELECT *, round_even(1e0 - miss, 4) AS fraud_probability FROM {name}1))"""


# ---- features and canonicalisation --------------------------------------------------

SQL["engineered_features"] = with_(APP, repaired("app"), derived_ctes("rep"), f"""
SELECT application_id, {r6(*v.DERIVED_NUMERIC)}, AgeGroup, IncomeQuartileBand FROM der""")

SQL["source_mapping"] = f"""
WITH s AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_totalprice AS credit,
  round((c_acctbal + 1000e0) * 12e0, 2) AS income,
  CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_orderkey % 23 AS DOUBLE) * 500e0 END AS annuity,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 80e0 END AS e1,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 90 AS DOUBLE) / 70e0 END AS e2,
  CASE WHEN o_orderkey % 2 <> 0 THEN CAST(o_orderkey % 80 AS DOUBLE) / 60e0 END AS e3,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 200 - o_orderkey % 6000 END AS emp,
  {pick('o_orderkey % 6', 'Secondary / secondary special', 'Lower secondary', 'Incomplete higher', 'Higher education', 'Academic degree', 'Other')} AS edu,
  {pick('o_custkey % 9', 'Working', 'Commercial associate', 'State servant', 'Pensioner', 'Businessman', 'Unemployed', 'Student', 'Maternity leave', None)} AS inc,
  {pick('o_custkey % 6', 'Married', 'Civil marriage', 'Single / not married', 'Separated', 'Widow', 'Unknown')} AS fam
 FROM orders JOIN customer ON c_custkey = o_custkey),
m AS (SELECT *, (coalesce(e1, 0e0) + coalesce(e2, 0e0) + coalesce(e3, 0e0)) / nullif((CASE WHEN e1 IS NULL THEN 0 ELSE 1 END
  + CASE WHEN e2 IS NULL THEN 0 ELSE 1 END + CASE WHEN e3 IS NULL THEN 0 ELSE 1 END), 0) AS ext FROM s)
SELECT k AS application_id, CASE WHEN st = 'F' THEN 1 ELSE 0 END AS "Default",
 round_even((7000 + (k * 13) % 18000) / 365.25e0, 1) AS Age,
 round({clip('(-emp / 30.44e0)', 0)}, 6) AS MonthsEmployed, income AS Income, credit AS LoanAmount,
 round_even(300e0 + {clip('ext', 0, 1)} * 550e0, 0) AS CreditScore, 0e0 AS InterestRate,
 {clip('round_even(credit / nullif(annuity, 0e0), 0)', 1, 480)} AS LoanTerm,
 round({clip('(annuity / nullif(income, 0e0))', 0, 1.5)}, 6) AS DTIRatio,
 {recode('edu', v.SOURCE_EDUCATION)} AS Education, {recode('inc', v.SOURCE_EMPLOYMENT)} AS EmploymentType,
 {recode('fam', v.SOURCE_MARITAL)} AS MaritalStatus,
 CASE WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS HasMortgage,
 CASE WHEN k % 4 <> 0 AND k % 3 > 0 THEN 'Yes' ELSE 'No' END AS HasDependents,
 CASE WHEN k % 4 IN (1, 2) THEN 'Yes' ELSE 'No' END AS HasCoSigner, 'Other' AS LoanPurpose FROM m"""

PAY = """pay AS (SELECT o_custkey AS id, CASE WHEN l_orderkey % 7 <> 0 THEN date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) END AS late0,
  CASE WHEN l_orderkey % 13 <> 0 THEN l_quantity * 1000e0 END AS inst, l_extendedprice AS paid
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 29 <> 0),
inst AS (SELECT id AS SK_ID_CURR, count(inst) AS InstallmentCount, avg(CASE WHEN late0 > 0 THEN 1e0 ELSE 0e0 END) AS InstallmentLatePaymentRate,
  avg(CASE WHEN late0 IS NOT NULL THEN greatest(CAST(late0 AS DOUBLE), 0e0) END) AS InstallmentAvgDaysLate,
  avg(CASE WHEN inst IS NOT NULL THEN least(greatest(paid / greatest(inst, 1e0), 0e0), 3e0) END) AS InstallmentAvgPaymentRatio
 FROM pay GROUP BY 1)"""
SQL["installment_history"] = with_(PAY, f"""SELECT SK_ID_CURR, InstallmentCount,
 {r6('InstallmentLatePaymentRate', 'InstallmentAvgDaysLate', 'InstallmentAvgPaymentRatio')} FROM inst""")

BUREAU = """rate AS (SELECT l_orderkey, avg(CASE WHEN l_linenumber IN (2, 4, 6) THEN 1e0 ELSE 0e0 END) AS dr
 FROM lineitem GROUP BY 1),
bur0 AS (SELECT o_custkey AS SK_ID_CURR, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS act,
  count(*) FILTER (o_orderkey % 4 - 1 > 0) AS ovd,
  coalesce(sum(CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END), 0e0) AS cr,
  coalesce(sum(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice * (o_orderkey % 10) / 4e0 END), 0e0) AS debt,
  avg(o_orderkey % 3000) AS days, avg(dr) AS dr FROM orders LEFT JOIN rate ON l_orderkey = o_orderkey GROUP BY 1),
bur AS (SELECT SK_ID_CURR, 1e0 AS HasBureauHistory, n AS BureauLoanCount, act AS BureauActiveLoanCount, ovd AS BureauOverdueLoanCount,
  least(greatest(debt / greatest(cr, 1e0), 0e0), 5e0) AS BureauDebtToCreditRatio, greatest(days, 0e0) AS BureauAvgDaysSinceCredit,
  dr AS BureauBalanceDelinquencyRate FROM bur0)"""
# months are numbered from 0 in the status list, so the delinquent ones are lines 2, 4 and 6
SQL["two_level_rate"] = with_(BUREAU, f"""SELECT SK_ID_CURR, HasBureauHistory, BureauLoanCount, BureauActiveLoanCount, BureauOverdueLoanCount,
 {r6('BureauDebtToCreditRatio', 'BureauAvgDaysSinceCredit', 'BureauBalanceDelinquencyRate')} FROM bur""")

PRIOR = """prior AS (SELECT o_custkey AS SK_ID_CURR, 1e0 AS HasPriorApplications, count(*) AS PriorApplicationCount,
  count(*) FILTER (o_orderstatus = 'F') / CAST(greatest(count(*), 1) AS DOUBLE) AS PriorApprovalRate,
  count(*) FILTER (o_orderstatus = 'P') / CAST(greatest(count(*), 1) AS DOUBLE) AS PriorRefusalRate FROM orders GROUP BY 1)"""
SQL["prior_applications"] = with_(PRIOR, f"""SELECT SK_ID_CURR, HasPriorApplications, PriorApplicationCount,
 {r6('PriorApprovalRate', 'PriorRefusalRate')} FROM prior""")

BAL = """bal AS (SELECT CASE WHEN l_partkey % 31 <> 0 THEN l_suppkey END AS id, l_extendedprice AS used,
  CASE WHEN l_quantity > 3 THEN l_quantity * 1500e0 ELSE 0e0 END AS lim,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_orderkey % 40 END AS dpd FROM lineitem),
card AS (SELECT id AS SK_ID_CURR, avg(least(greatest(used / greatest(lim, 1e0), 0e0), 3e0)) AS CreditCardUtilizationRatio,
  max(dpd) AS CreditCardMaxDaysPastDue FROM bal WHERE id IS NOT NULL GROUP BY 1),
pos AS (SELECT id AS SK_ID_CURR, avg(dpd) AS PosAvgDaysPastDue, max(dpd) AS PosMaxDaysPastDue FROM bal WHERE id IS NOT NULL GROUP BY 1)"""
SQL["card_utilisation"] = with_(BAL, f"SELECT SK_ID_CURR, {r6('CreditCardUtilizationRatio')}, CreditCardMaxDaysPastDue FROM card")
SQL["pos_dpd"] = with_(BAL, f"SELECT SK_ID_CURR, {r6('PosAvgDaysPastDue')}, PosMaxDaysPastDue FROM pos")

_exact = {"BureauLoanCount", "BureauActiveLoanCount", "BureauOverdueLoanCount", "PriorApplicationCount", "InstallmentCount",
          "PosMaxDaysPastDue", "CreditCardMaxDaysPastDue"}
SQL["canonical_join"] = with_(PAY, BUREAU, PRIOR, BAL, f"""
SELECT c_custkey AS SK_ID_CURR, c_acctbal AS Income, CAST(BureauLoanCount AS DOUBLE) AS NumCreditLines,
 coalesce(HasBureauHistory, 0e0) AS HasBureauHistory, coalesce(HasPriorApplications, 0e0) AS HasPriorApplications,
 {', '.join(c if c in _exact else f'round({c}, 6) AS {c}' for c in v.HISTORY_NUMERIC if not c.startswith('Has'))}
FROM customer LEFT JOIN bur ON bur.SK_ID_CURR = c_custkey LEFT JOIN prior ON prior.SK_ID_CURR = c_custkey
 LEFT JOIN inst ON inst.SK_ID_CURR = c_custkey LEFT JOIN pos ON pos.SK_ID_CURR = c_custkey LEFT JOIN card ON card.SK_ID_CURR = c_custkey""")

# ---- payloads and quality -----------------------------------------------------------


def _level(name: str, raw: str) -> str:
    t = f"trim({raw})"
    return f"CASE WHEN {t} IN {in_list(v.LEVELS[name])} THEN {t} ELSE {recode(f'lower({t})', v.PAYLOAD_LEVELS[name])} END"


_imputed = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in v.BASE) + ")"
SQL["payload_normalise"] = with_(APP, f"""
n0 AS (SELECT application_id, application_id AS k, CreditScore, LoanAmount, LoanTerm,
  CASE WHEN application_id % 21 = 0 THEN 41.5e0 WHEN application_id % 6 <> 0 THEN Age END AS Age,
  {pick('application_id % 5', 'single', 'MARRIED', 'divorced', 'widowed', 'unknown')} AS ms,
  {pick('application_id % 8', 'full_time', 'part_time', 'self_employed', 'contract', 'retired', 'unemployed', 'Full-time', None)} AS et,
  CASE WHEN application_id % 4 <> 0 THEN application_id % 3 END AS dep,
  {pick('application_id % 6', 'high_school', 'bachelors', ' masters ', 'doctorate', 'other', 'PhD')} AS ed,
  CASE WHEN application_id % 10 <> 0 THEN Income END AS nested_income,
  CASE WHEN application_id % 7 <> 0 THEN CAST(application_id % 5 AS DOUBLE) * 9000e0 END AS debts,
  {pick('application_id % 9', 'home_purchase', 'auto_loan', 'education', 'business', 'personal', 'debt_consolidation', 'medical', 'other', 'Home')} AS pu FROM app)""",
f"""n1 AS (SELECT application_id, Age,
  coalesce(CASE WHEN k % 24 = 0 THEN 77777e0 WHEN k % 12 = 0 THEN 55555e0 END, nested_income) AS Income,
  LoanAmount, CreditScore, CASE WHEN k % 8 = 5 THEN 0e0 END AS MonthsEmployed, CAST(NULL AS DOUBLE) AS NumCreditLines,
  CAST(NULL AS DOUBLE) AS InterestRate, LoanTerm,
  CASE WHEN k % 15 = 0 THEN 0.33e0 WHEN debts <> 0 AND nested_income > 0 THEN least(greatest(debts / nested_income, 0e0), 1.5e0) END AS DTIRatio,
  {_level('Education', 'ed')} AS Education, {_level('EmploymentType', 'et')} AS EmploymentType, {_level('MaritalStatus', 'ms')} AS MaritalStatus,
  CASE k % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' WHEN 2 THEN 'Yes' END AS HasMortgage,
  CASE WHEN dep IS NULL THEN NULL WHEN dep <> 0 THEN 'Yes' ELSE 'No' END AS HasDependents,
  {_level('LoanPurpose', 'pu')} AS LoanPurpose, CASE WHEN k % 14 = 0 THEN 'No' END AS HasCoSigner FROM n0)""",
f"SELECT application_id, {', '.join(c for c in v.BASE if c != 'DTIRatio')}, round(DTIRatio, 6) AS DTIRatio, {_imputed} AS imputed FROM n1")

SQL["intake_quarantine"] = with_(APP, """
q AS (SELECT application_id, application_id % 113 = 0 AS blank, application_id AS k, Age, Income, LoanTerm, CreditScore FROM app),
w AS (SELECT application_id, concat_ws(',', CASE WHEN NOT blank AND k % 50 = 0 THEN 'personalInfo.age' END,
  CASE WHEN NOT blank AND k % 60 = 0 THEN 'personalInfo.dependents' END,
  CASE WHEN NOT blank AND k % 70 = 0 THEN 'financialInfo.income' END,
  CASE WHEN NOT blank AND k % 80 = 0 THEN 'financialInfo.tenure' END,
  CASE WHEN NOT blank AND k % 90 = 0 THEN 'financialInfo.creditScore' END,
  CASE WHEN blank THEN 'no_signal' END) AS violations FROM q)""",
"SELECT * FROM w WHERE violations <> ''")

SQL["document_constraints"] = with_(APP, """
v AS (SELECT unnest([CASE WHEN application_id % 41 = 0 THEN 'applicantId:required' END,
  CASE WHEN application_id % 5 = 4 THEN 'personalInfo.maritalStatus:enum' END,
  CASE WHEN application_id % 5 = 0 THEN 'personalInfo.dependents:range' END,
  CASE WHEN application_id % 43 = 0 THEN 'financialInfo.income:required' END,
  CASE WHEN application_id % 43 <> 0 AND Income < 0 THEN 'financialInfo.income:range' END,
  CASE WHEN LoanAmount < 100 THEN 'financialInfo.loanAmountRequested:range' END,
  CASE WHEN LoanTerm * 7 > 360 THEN 'financialInfo.tenure:range' END,
  CASE WHEN CreditScore + 10 > 850 THEN 'financialInfo.creditScore:range' END,
  CASE WHEN application_id % 37 = 0 THEN 'status:enum' END,
  CASE WHEN application_id % 10 > 5 THEN 'notes:length' END]) AS rule FROM app)""",
"SELECT rule, count(*) AS n FROM v WHERE rule IS NOT NULL GROUP BY 1")

MESSY = """messy AS (SELECT application_id, Age,
  CASE WHEN application_id % 97 = 0 THEN 'abc' WHEN application_id % 89 = 0 THEN NULL ELSE CAST(CAST(floor(Income) AS BIGINT) AS VARCHAR) END AS inc_text,
  CASE WHEN application_id % 97 = 0 OR application_id % 89 = 0 THEN NULL ELSE floor(Income) END AS Income, LoanAmount,
  CASE WHEN application_id % 101 = 0 THEN 9999e0 WHEN application_id % 103 = 0 THEN -50e0 ELSE CreditScore END AS CreditScore,
  MonthsEmployed, CAST(NULL AS DOUBLE) AS NumCreditLines, CAST(NULL AS DOUBLE) AS InterestRate, LoanTerm, DTIRatio,
  Education, EmploymentType, MaritalStatus, HasMortgage, HasDependents, LoanPurpose, CAST(NULL AS VARCHAR) AS HasCoSigner,
  CASE WHEN application_id % 107 = 0 THEN 5 ELSE "Default" END AS "Default" FROM app)"""
SQL["repair_clip"] = with_(APP, MESSY, "SELECT application_id, " + ", ".join(
    f"{clip(c, *bnd)} AS {c}" for c, bnd in v.NUMERIC_BOUNDS.items()) + ", " + ", ".join(
    f"CASE WHEN {c} IN {in_list(x)} THEN {c} END AS {c}" for c, x in v.LEVELS.items()) + " FROM messy")


def _finding(column: str, check: str, n: str, severity: str, detail: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT '{column}' AS \"column\", '{check}' AS \"check\", CAST({n} AS BIGINT) AS n, {detail} AS detail, '{severity}' AS severity FROM messy"


_f = [_finding("Income", "non_numeric", "count(*) FILTER (inc_text = 'abc')", "error")]
for _c, (_lo, _hi) in v.NUMERIC_BOUNDS.items():
    if _c not in ("NumCreditLines", "InterestRate"):
        _f.append(_finding(_c, "missing", f"count(*) FILTER ({_c} IS NULL)", "info"))
        _f.append(_finding(_c, "out_of_range", f"count(*) FILTER ({_c} < {_lo} OR {_c} > {_hi})", "warning"))
for _c, _x in v.LEVELS.items():
    if _c != "HasCoSigner":
        _f.append(_finding(_c, "missing", f"count(*) FILTER ({_c} IS NULL)", "info"))
        _f.append(_finding(_c, "unknown_level", "count(*)", "warning", _c) + f" WHERE {_c} NOT IN {in_list(_x)} GROUP BY {_c}")
_f.append(_finding("Default", "not_binary", "count(*) FILTER (\"Default\" NOT IN (0, 1))", "error"))
_f += [f"SELECT '{c}', 'missing_column', 1, NULL, 'error'" for c in ("NumCreditLines", "InterestRate", "HasCoSigner")]
SQL["validation_report"] = with_(APP, MESSY, "SELECT * FROM (" + " UNION ALL ".join(_f) + ") WHERE n > 0")

# ---- fraud --------------------------------------------------------------------------

SQL["fraud_rules"] = with_(APP, rules_cte("app"), """SELECT application_id, fraud_probability, fraud_flag, fraud_tier, codes, reasons,
 CASE WHEN fraud_flag THEN reasons END AS fraud_reason FROM fr""")
SQL["fraud_summary"] = with_(APP, repaired("app"), derived_ctes("rep"), rules_cte("der"), """
SELECT fraud_tier, count(*) AS applications, count(*) FILTER (fraud_flag) AS flagged,
 round(avg(LoanToIncomeRatio), 6) AS mean_loan_to_income, round(avg(ThinFileScore), 6) AS mean_thin_file FROM fr GROUP BY 1""")

SQL["resubmission"] = with_(APP, "app2 AS (SELECT * REPLACE (2e0 AS NumCreditLines) FROM app)", rules_cte("app2"), """
s AS (SELECT *, left(sha256(concat_ws('|', CAST(nation AS VARCHAR), lower(segment))), 32) AS fingerprint FROM fr),
w AS (SELECT *, row_number() OVER win AS occurrence, lag(application_id) OVER win AS previous_id, lag(ts) OVER win AS previous_ts,
  lag(Income) OVER win AS pi, lag(LoanAmount) OVER win AS pl FROM s WINDOW win AS (PARTITION BY fingerprint ORDER BY ts, application_id)),
x AS (SELECT *, round_even(100e0 * (Income - pi) / nullif(abs(pi), 0e0), 2) AS Income_change_pct,
  round_even(100e0 * (LoanAmount - pl) / nullif(abs(pl), 0e0), 2) AS LoanAmount_change_pct FROM w),
y AS (SELECT *, CASE WHEN occurrence = 1 THEN NULL WHEN Income_change_pct > 20 THEN 'DUPLICATE_WITH_INFLATED_INCOME' ELSE 'DUPLICATE_APPLICATION' END AS extra,
  CASE WHEN occurrence = 1 THEN 0e0 WHEN Income_change_pct > 20 THEN 0.55e0 WHEN occurrence = 2 THEN 0.25e0 ELSE 0.4e0 END AS ew FROM x),
z AS (SELECT *, round_even(1e0 - miss * (1e0 - ew), 4) AS fp2 FROM y)""", """
SELECT application_id, fingerprint, occurrence, previous_id, previous_ts, Income_change_pct, LoanAmount_change_pct,
 fp2 AS fraud_probability, CASE WHEN fp2 >= 0.55 THEN 'high' WHEN fp2 >= 0.25 THEN 'medium' ELSE 'low' END AS fraud_tier,
 concat_ws(',', nullif(codes, ''), extra) AS codes FROM z""")


def _dups(source: str) -> str:
    return with_(*source.split("\x00"), """
c AS (SELECT key, count(*) AS occurrences FROM keyed GROUP BY 1 HAVING count(*) > 1),
top AS (SELECT * FROM c ORDER BY occurrences DESC, key LIMIT 50),
m AS (SELECT key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM
  (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS rn FROM keyed) WHERE rn <= 20 GROUP BY 1)""",
 """SELECT top.key, occurrences, members, (SELECT count(*) FROM c) AS duplicate_groups,
 (SELECT coalesce(sum(occurrences), 0)::BIGINT FROM c) AS duplicate_rows FROM top JOIN m USING (key)""")


SQL["duplicate_groups"] = _dups("keyed AS (SELECT left(sha256(text), 16) AS key, doc_id AS id FROM documents)")
SQL["identity_duplicates"] = _dups(APP + "\x00" + """keyed AS (SELECT application_id AS id, left(sha256(concat_ws('|', CAST(Age AS VARCHAR),
 coalesce(lower(EmploymentType), 'none'), coalesce(lower(MaritalStatus), 'none'), coalesce(lower(Education), 'none'), lower(HasDependents))), 16) AS key FROM app)""")

# ---- scoring and decisions ------------------------------------------------------------

SC = scored("app")
SQL["score_bands"] = with_(APP, SC, """SELECT application_id, risk_score, risk_level, round(confidence, 6) AS confidence,
 round(0.55e0 + 0.45e0 * abs(probability - 0.5e0) * 2e0, 6) AS plain_confidence FROM sc""")
SQL["band_table"] = with_(APP, SC, """SELECT level, count(risk_level) AS count, round(count(risk_level) / (SELECT CAST(count(*) AS DOUBLE) FROM sc), 6) AS share,
 round(coalesce(avg("Default"), 0e0), 6) AS default_rate FROM (VALUES ('low'), ('medium'), ('high')) t(level) LEFT JOIN sc ON risk_level = level GROUP BY 1""")
SQL["score_distribution"] = with_(APP, SC, """SELECT round(avg(risk_score), 6) AS mean, round(quantile_cont(risk_score, 0.1), 6) AS p10,
 round(quantile_cont(risk_score, 0.5), 6) AS p50, round(quantile_cont(risk_score, 0.9), 6) AS p90 FROM sc""")
_levels = ", ".join(f"count(*) FILTER (risk_level = '{x}') AS {x}" for x in v.RISK_LEVELS)
SQL["risk_distribution"] = with_(APP, SC, f"SELECT {_levels} FROM sc")
SQL["batch_summary"] = with_(APP, SC, rules_cte("sc"), f"""SELECT round_even(avg(risk_score), 2) AS mean_risk_score, {_levels},
 count(*) FILTER (fraud_flag) AS flagged_for_fraud FROM fr""")
DEC = """dec AS (SELECT * REPLACE (CASE ai_recommendation WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'under_review' END AS status),
  nullif(ai_recommendation, 'review') AS final_decision FROM (SELECT *, CASE WHEN risk_score <= 25 AND NOT fraud_flag THEN 'approve'
  WHEN risk_score >= 75 OR fraud_flag THEN 'reject' ELSE 'review' END AS ai_recommendation FROM fr))"""
SQL["auto_decision"] = with_(APP, SC, rules_cte("sc"), DEC, "SELECT application_id, ai_recommendation, status, final_decision FROM dec")
SQL["auto_decision_audit"] = with_(APP, SC, rules_cte("sc"), DEC, """SELECT 'AI' AS actor_type, 'AI' AS actor_id, application_id,
 'Auto-' || final_decision || ' application' AS action, risk_score AS ai_score, CAST(NULL AS VARCHAR) AS override_reason,
 'Application auto-' || final_decision || ' based on score ' || CAST(risk_score AS VARCHAR) || '. Fraud flag: ' || CAST(fraud_flag AS VARCHAR) AS details
FROM dec WHERE final_decision IS NOT NULL""")
SQL["decision_notifications"] = with_(APP, SC, rules_cte("sc"), DEC, """SELECT applicant_id AS user_id,
 'Application ' || upper(left(final_decision, 1)) || substr(final_decision, 2) AS title,
 'Your loan application has been ' || final_decision || '.' AS message, 'status_update' AS type, false AS read, count(*) AS n
FROM dec WHERE final_decision IS NOT NULL GROUP BY ALL""")

MAN = f"""m0 AS (SELECT o_orderkey AS application_id, o_custkey AS applicant_id, o_orderkey % 7 AS officer_id,
  {pick('o_orderkey % 5', 'approve', 'reject', 'review', 'approve', 'escalate')} AS decision,
  CASE WHEN o_orderkey % 3 <> 0 THEN 'note ' || o_orderkey END AS override_reason,
  CASE WHEN o_orderkey % 8 <> 0 THEN {score('(CAST(o_orderkey % 1000 AS DOUBLE) / 1000e0)')} END AS risk_score FROM orders),
m1 AS (SELECT *, CASE WHEN risk_score > 50 THEN 'reject' WHEN risk_score IS NOT NULL THEN 'approve' END AS rec FROM m0),
m2 AS (SELECT *, coalesce(decision <> rec AND decision <> 'review', false) AS is_override FROM m1),
man AS (SELECT application_id, applicant_id, officer_id, decision, override_reason, risk_score, coalesce(rec, 'review') AS ai_recommendation, is_override,
  decision IN ('approve', 'reject', 'review') AND (NOT is_override OR override_reason IS NOT NULL) AS accepted,
  nullif(decision, 'review') AS final_decision, CASE WHEN is_override THEN override_reason END AS recorded_reason,
  CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'under_review' END AS status FROM m2)"""
SQL["manual_override"] = with_(MAN, "SELECT * FROM man")
SQL["officer_audit"] = with_(MAN, """SELECT 'Officer' AS actor_type, CAST(officer_id AS VARCHAR) AS actor_id, application_id,
 'Officer ' || decision || ' application' AS action, risk_score AS ai_score, recorded_reason AS override_reason,
 'Officer manually set status to ' || decision AS details FROM man WHERE accepted""")
SQL["eligibility"] = with_(APP, """e AS (SELECT application_id, CAST(floor(least(greatest(400e0 + least(CreditScore / 850e0, 1e0) * 200e0
  + greatest(0e0, (36e0 - DTIRatio * 100e0) / 36e0) * 100e0 + least(MonthsEmployed / 12e0 / 10e0, 1e0) * 50e0
  + coalesce(CASE WHEN Income = 0 THEN 0e0 ELSE greatest(0e0, (5e0 - LoanAmount / Income) / 5e0) END, 0e0) * 80e0
  + CASE WHEN Income > 60000 THEN 20e0 ELSE 0e0 END, 0e0), 850e0) + 0.5e0) AS INTEGER) AS pts, MonthsEmployed FROM app),
f AS (SELECT application_id, pts AS points FROM e)""", """
SELECT application_id, points, CASE WHEN points >= 700 THEN 'Likely Eligible' WHEN points >= 550 THEN 'Potentially Eligible' ELSE 'May Need Improvement' END AS band,
 CASE WHEN points >= 700 THEN 'Low Risk' WHEN points >= 550 THEN 'Moderate Risk' ELSE 'High Risk' END AS risk FROM f""")

_p = "(0.6e0 * least({loan} / nullif({inc} + 1000e0, 0e0) / 20e0, 1e0) + 0.4e0 * (850e0 - CreditScore) / 550e0)"
SQL["scenario_table"] = with_(APP, f"""
b0 AS (SELECT application_id, Income, LoanAmount, LoanTerm, CreditScore, {score(_p.format(loan='LoanAmount', inc='Income'))} AS baseline_score FROM app),
v0 AS (SELECT *, 'raise_income' AS scenario, round(Income * 1.5e0, 2) AS i2, LoanAmount AS l2, LoanTerm AS t2 FROM b0
 UNION ALL SELECT *, 'smaller_loan', Income, round(LoanAmount * 0.8e0, 2), 24e0 FROM b0
 UNION ALL SELECT *, 'unchanged', Income, LoanAmount, LoanTerm FROM b0),
v1 AS (SELECT *, {score(_p.format(loan='l2', inc='i2'))} AS risk_score,
  concat_ws(', ', CASE WHEN i2 <> Income THEN 'Annual income -> ' || printf('%.2f', i2) END,
   CASE WHEN l2 <> LoanAmount THEN 'Requested loan amount -> ' || printf('%.2f', l2) END,
   CASE WHEN t2 <> LoanTerm THEN 'Loan term (months) -> ' || printf('%.2f', t2) END) AS changed_fields FROM v0)""", f"""
SELECT application_id, scenario, baseline_score, {level('baseline_score')} AS baseline_level, risk_score, {level('risk_score')} AS risk_level,
 round_even(risk_score - baseline_score, 2) AS score_change, risk_score - baseline_score < 0 AS improved, changed_fields,
 'Adjusting ' || coalesce(nullif(changed_fields, ''), 'no fields') || ' ' || CASE WHEN abs(risk_score - baseline_score) < 0.5 THEN 'leaves the risk score essentially unchanged'
  WHEN risk_score < baseline_score THEN 'lowers the risk score by ' || CAST(round_even(baseline_score - risk_score, 0) AS BIGINT) || ' points'
  ELSE 'raises the risk score by ' || CAST(round_even(risk_score - baseline_score, 0) AS BIGINT) || ' points' END
  || ', from ' || CAST(round_even(baseline_score, 0) AS BIGINT) || ' to ' || CAST(round_even(risk_score, 0) AS BIGINT) || '.' AS narrative FROM v1""")

# ---- metrics --------------------------------------------------------------------------

LAB = "lab AS (SELECT doc_id, quality AS y, n_chars / (n_chars + 2048e0) AS p FROM documents JOIN labels USING (doc_id))"
CM = """SELECT {k} count(*) AS n, count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp,
 count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn, avg((p - y) * (p - y)) AS brier FROM {s} {g}"""
CM_OUT = """n, tp, fp, fn, tn, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy,
 round((coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0e0) + coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0e0))
  / ((CASE WHEN tp + fn > 0 THEN 1e0 ELSE 0e0 END) + (CASE WHEN tn + fp > 0 THEN 1e0 ELSE 0e0 END)), 6) AS balanced_accuracy,
 round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0e0), 6) AS precision, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0e0), 6) AS recall,
 round(coalesce(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 0e0), 6) AS f1, round(brier, 6) AS brier_score, tp + fn AS positives, fp + tn AS negatives"""
SQL["classification_metrics"] = with_(LAB, f"cm AS ({CM.format(k='', s='lab', g='')})", f"SELECT {CM_OUT} FROM cm")


def rank_cte(source: str, key: str = "", name: str = "rk") -> str:
    k, part = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    return f"""{name}0 AS (SELECT {k}p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY ALL),
{name}1 AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS cp, CAST(sum(neg) OVER w AS BIGINT) AS cn FROM {name}0 WINDOW w AS ({part}ORDER BY p DESC)),
{name} AS (SELECT {k}sum(CAST(neg AS DOUBLE) * (cp - pos) + 0.5e0 * neg * pos) / nullif(CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS roc_auc,
  sum(CAST(pos AS DOUBLE) * cp / (cp + cn)) / nullif(CAST(sum(pos) AS DOUBLE), 0) AS average_precision FROM {name}1 {'GROUP BY ' + key if key else ''})"""


SQL["auc_ap"] = with_(LAB, rank_cte("lab"), f"SELECT {r6('roc_auc', 'average_precision')} FROM rk")
SQL["threshold_tuning"] = with_(LAB, rank_cte("lab"), """
b AS (SELECT avg(y) AS rate, CAST(sum(y) AS DOUBLE) AS pp, quantile_cont(p, 0.25) AS q25, quantile_cont(p, 0.95) AS q95 FROM lab),
c AS (SELECT p, cp / pp AS rec, cp / CAST(cp + cn AS DOUBLE) AS prec, rate FROM rk1, b),
f AS (SELECT *, coalesce(2e0 * prec * rec / nullif(prec + rec, 0e0), 0e0) AS f1 FROM c),
t AS (SELECT (SELECT max(p) FROM f WHERE rec >= 0.95e0) AS lo, (SELECT min(p) FROM f WHERE prec >= least(0.95e0, rate * 2.5e0)) AS hi,
  (SELECT p FROM f ORDER BY f1 DESC, p LIMIT 1) AS dec),
u AS (SELECT least(greatest(coalesce(lo, q25), 1e-4), 0.98e0) AS low, coalesce(hi, q95) AS hi, dec, rate FROM t, b)""", """
SELECT round(low, 6) AS low, round(least(greatest(hi, low + 1e-3), 0.999e0), 6) AS high, round(dec, 6) AS decision, round(rate, 6) AS base_rate FROM u""")
SQL["curve_points"] = with_(LAB, rank_cte("lab"), """
tot AS (SELECT CAST(sum(pos) AS DOUBLE) AS pp, CAST(sum(neg) AS DOUBLE) AS nn FROM rk0),
r0 AS (SELECT *, row_number() OVER (ORDER BY p DESC) AS j, lead(pos) OVER (ORDER BY p DESC) AS np, lead(neg) OVER (ORDER BY p DESC) AS nq FROM rk1),
r1 AS (SELECT row_number() OVER (ORDER BY p DESC) AS i, cn / nn AS x, cp / pp AS y FROM r0, tot WHERE j = 1 OR np IS NULL OR np <> pos OR nq <> neg),
roc AS (SELECT i, x, y FROM r1 UNION ALL SELECT 0, 0e0, 0e0),
p1 AS (SELECT row_number() OVER (ORDER BY p) - 1 AS i, cp / pp AS x, cp / CAST(cp + cn AS DOUBLE) AS y FROM rk1, tot),
pr AS (SELECT i, x, y FROM p1 UNION ALL SELECT (SELECT count(*) FROM rk1), 0e0, 1e0),
pts AS (SELECT 'roc' AS curve, *, (SELECT count(*) FROM roc) AS n FROM roc UNION ALL SELECT 'precision_recall', *, (SELECT count(*) FROM pr) FROM pr)""", """
SELECT curve, i, round(x, 6) AS x, round(y, 6) AS y FROM pts
WHERE n <= 200 OR EXISTS (SELECT 1 FROM range(200) g(k) WHERE i = CAST(floor(CAST(k * (n - 1) AS DOUBLE) / 199) AS BIGINT))""")

PER = """per AS (SELECT strftime(ts, '%Y-%m') AS period, "Default" AS y, CASE WHEN month(ts) % 4 = 1 THEN (application_id * 7919 % 1000) / 1000e0
  ELSE 0.6e0 * ((application_id * 7919 % 1000) / 1000e0) + 0.4e0 * "Default" END AS p FROM app)"""
SQL["period_metrics"] = with_(APP, PER, rank_cte("per", "period"), f"cm AS ({CM.format(k='period,', s='per', g='GROUP BY period')})",
 f"SELECT period, 'v1' AS model_version, {CM_OUT}, {r6('roc_auc', 'average_precision')}, roc_auc < 0.68e0 AS low_auc FROM cm JOIN rk USING (period)")
TREND = """h AS (SELECT * FROM rk WHERE roc_auc IS NOT NULL ORDER BY period DESC LIMIT 100),
tr AS (SELECT period, roc_auc AS auc, coalesce((SELECT avg(roc_auc) FROM h x WHERE x.period < h.period), roc_auc, 0e0) AS base FROM h ORDER BY period DESC LIMIT 1),
trend AS (SELECT period, round_even(base, 4) AS baseline_auc, auc AS latest_auc, round_even(base - auc, 4) AS auc_degradation, auc < 0.68e0 AS below_minimum,
  base - auc > 0.03e0 AS significant_drop, auc < 0.68e0 OR base - auc > 0.03e0 AS alert,
  CASE WHEN auc < 0.68e0 OR base - auc > 0.03e0 THEN 'degraded' ELSE 'healthy' END AS status,
  CASE WHEN auc < 0.68e0 THEN 'Trigger retraining: performance has fallen below the acceptable threshold.'
   WHEN base - auc > 0.03e0 THEN 'Investigate: AUC dropped materially versus the historical baseline.' ELSE 'No action required.' END AS recommendation FROM tr)"""
SQL["performance_trend"] = with_(APP, PER, rank_cte("per", "period"), TREND, "SELECT * REPLACE (round(latest_auc, 6) AS latest_auc) FROM trend")

DECI = """deci AS (SELECT o_orderkey AS application_id, o_orderdate AS decided_at, 'officer-' || (o_orderkey % 7) AS decided_by,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'approve' WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'reject' ELSE 'review' END AS ai_recommendation,
  CASE o_orderstatus WHEN 'F' THEN 'approve' WHEN 'O' THEN 'reject' END AS final_decision FROM orders)"""
SQL["agreement"] = with_(DECI, """c AS (SELECT * FROM deci WHERE ai_recommendation IN ('approve', 'reject') AND final_decision IS NOT NULL),
a AS (SELECT avg(CASE WHEN ai_recommendation = final_decision THEN 1e0 ELSE 0e0 END) AS rate, count(*) AS n,
  count(*) FILTER (ai_recommendation = 'reject' AND final_decision = 'approve') AS ra, count(*) FILTER (ai_recommendation = 'approve' AND final_decision = 'reject') AS ar FROM c)""", """
SELECT round_even(rate, 4) AS agreement_rate, n AS sample_size, ra + ar AS override_count, ra AS reject_to_approve, ar AS approve_to_reject,
 CASE WHEN rate IS NULL THEN 'no_data' WHEN rate >= 0.8e0 THEN 'healthy' WHEN rate >= 0.65e0 THEN 'review' ELSE 'concerning' END AS status,
 'Officers accept the model''s recommendation in ' || CAST(round_even(rate * 100e0, 0) AS BIGINT) || '% of comparable decisions.' ||
 CASE WHEN ra > ar THEN ' Officers overturn declines more often than approvals, which suggests the model is too conservative.'
  WHEN ar > ra THEN ' Officers overturn approvals more often than declines, which suggests the model is too permissive.' ELSE '' END AS interpretation FROM a""")

PRED = f"""pred AS (SELECT *, {level('risk_score')} AS risk_level FROM (SELECT ts AS timestamp, event_id, user_id, event_type, value,
  {score('(CAST(event_id % 1000 AS DOUBLE) / 1000e0)')} AS risk_score, event_id % 37 = 0 AS fraud_flag FROM events)),
lastn AS (SELECT * FROM pred ORDER BY timestamp DESC, event_id DESC LIMIT 1000)"""
_nl = ", ".join(f"count(*) FILTER (risk_level = '{x}') AS n_{x}" for x in v.RISK_LEVELS)
THR = f"""thr AS (SELECT count(*) AS total_predictions, round_even(avg(value), 2) AS avg_latency_ms, round_even(quantile_cont(value, 0.95), 2) AS p95_latency_ms,
  round_even(avg(risk_score), 2) AS mean_risk_score, {_nl}, count(*) FILTER (fraud_flag) AS fraud_flagged, min(timestamp) AS window_start, max(timestamp) AS window_end FROM lastn)"""
SQL["throughput_lastn"] = with_(PRED, THR, "SELECT * FROM thr")

# ---- fairness ---------------------------------------------------------------------------

_lean = "(CASE WHEN segment = 'BUILDING' THEN least(probability * 3, 1e0) ELSE probability * 0.2e0 END)"
FAIRS = (APP, derived_ctes("app"), f"au AS (SELECT *, {score(_lean)} AS risk_score FROM der)", """
long AS (SELECT attribute, coalesce(g, 'unknown') AS "group", CASE WHEN risk_score < 25 THEN 1e0 ELSE 0e0 END AS a, "Default" AS y FROM (
  SELECT 'AgeGroup' AS attribute, AgeGroup AS g, risk_score, "Default" FROM au UNION ALL SELECT 'MaritalStatus', MaritalStatus, risk_score, "Default" FROM au
  UNION ALL SELECT 'EmploymentType', EmploymentType, risk_score, "Default" FROM au UNION ALL SELECT 'segment', segment, risk_score, "Default" FROM au)),
gs AS (SELECT attribute, "group", count(*) AS count, avg(a) AS approval_rate, avg(a) FILTER (y = 0) AS creditworthy_approval_rate,
  CASE WHEN count(*) FILTER (y = 1) > 0 THEN avg(y) END AS default_rate, avg(a) FILTER (y = 1) AS defaulter_approval_rate, count(*) >= 30 AS sufficient_sample FROM long GROUP BY 1, 2)""")
SQL["fairness_groups"] = with_(*FAIRS, f"""SELECT attribute, "group", count, {r6('approval_rate', 'creditworthy_approval_rate', 'default_rate', 'defaulter_approval_rate')}, sufficient_sample FROM gs""")
AUDIT = """ok AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY approval_rate DESC, "group") AS hi, row_number() OVER (PARTITION BY attribute ORDER BY approval_rate, "group") AS lo
  FROM gs WHERE sufficient_sample),
g1 AS (SELECT attribute, count(*) AS usable_groups, max(CASE WHEN hi = 1 THEN "group" END) AS mg, max(CASE WHEN hi = 1 THEN approval_rate END) AS mr, max(CASE WHEN hi = 1 THEN count END) AS mn,
  max(CASE WHEN lo = 1 THEN "group" END) AS lg, max(CASE WHEN lo = 1 THEN approval_rate END) AS lr, max(CASE WHEN lo = 1 THEN count END) AS lnn,
  CASE WHEN count(creditworthy_approval_rate) >= 2 THEN round_even(max(creditworthy_approval_rate) - min(creditworthy_approval_rate), 4) END AS eo FROM ok GROUP BY 1),
g2 AS (SELECT *, coalesce(lr / nullif(mr, 0e0), 1e0) AS di, mr - lr AS pd, (mr * mn + lr * lnn) / (mn + lnn) AS pool FROM g1),
g3 AS (SELECT *, pool * (1e0 - pool) * (1e0 / mn + 1e0 / lnn) AS var FROM g2),
aud AS (SELECT *, usable_groups >= 2 AND (di < 0.8e0 OR pd > 0.1e0) AND CASE WHEN mr = lr THEN false WHEN var <= 0 THEN true ELSE abs(mr - lr) / sqrt(greatest(var, 0e0)) >= 1.959964e0 END AS bias_alert FROM g3)"""
SQL["fairness_audit"] = with_(*FAIRS, AUDIT, """SELECT attribute, usable_groups, mg AS most_favoured, round(mr, 6) AS most_favoured_rate, lg AS least_favoured,
 round(lr, 6) AS least_favoured_rate, round_even(di, 4) AS disparate_impact_ratio, round_even(pd, 4) AS parity_difference, eo AS equal_opportunity_gap, di >= 0.8e0 AS passes_four_fifths, bias_alert,
 CASE WHEN bias_alert THEN attribute || ': approval rate for ''' || lg || ''' is ' || printf('%.1f', lr * 100e0) || '% vs ' || printf('%.1f', mr * 100e0) || '% for ''' || mg
  || ''' (disparate impact ratio ' || printf('%.2f', round_even(di, 4)) || ').' END AS alert,
 (SELECT count(*) FROM au) AS n_applications, (SELECT round(avg(CASE WHEN risk_score < 25 THEN 1e0 ELSE 0e0 END), 6) FROM au) AS overall_approval_rate,
 (SELECT round(avg(risk_score), 6) FROM au) AS overall_mean_score FROM aud""")
SQL["aligned_outcomes"] = """SELECT d.doc_id IS NULL OR l.doc_id IS NULL AS unmatched, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positives
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""

# ---- drift ------------------------------------------------------------------------------


def halves(scale: str = "1e0") -> str:
    return f"""ref AS (SELECT value, CAST(user_id AS DOUBLE) AS user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16'),
cur AS (SELECT value * {scale} AS value, CAST(user_id AS DOUBLE) AS user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16')"""


def psi_cte(c: str, name: str, ref: str = "ref", cur: str = "cur") -> str:
    probs = ", ".join(f"{i / 10!r}" for i in range(11))
    return f"""{name}e AS (SELECT list_sort(list_distinct(quantile_cont({c}, [{probs}]))) AS e FROM {ref}),
{name}i AS (SELECT unnest(e[2:len(e) - 1]) AS edge FROM {name}e),
{name}b AS (SELECT side, (SELECT count(*) FROM {name}i WHERE edge <= x) AS bin FROM (SELECT 'e' AS side, {c} AS x FROM {ref} UNION ALL SELECT 'a', {c} FROM {cur})),
{name}s AS (SELECT bin, greatest(count(*) FILTER (side = 'e') / (SELECT CAST(count(*) AS DOUBLE) FROM {ref}), 1e-6) AS e,
  greatest(count(*) FILTER (side = 'a') / (SELECT CAST(count(*) AS DOUBLE) FROM {cur}), 1e-6) AS a FROM {name}b GROUP BY 1),
{name} AS (SELECT '{c}' AS feature, 'numeric' AS kind, sum((a - e) * ln(a / e)) AS psi FROM {name}s)"""


def cat_cte(c: str, name: str, ref: str = "ref", cur: str = "cur") -> str:
    return f"""{name}s AS (SELECT coalesce(x.l, y.l) AS l, greatest(coalesce(x.n, 0) / (SELECT CAST(count({c}) AS DOUBLE) FROM {ref}), 1e-6) AS e,
  greatest(coalesce(y.n, 0) / (SELECT CAST(count({c}) AS DOUBLE) FROM {cur}), 1e-6) AS a FROM (SELECT {c} AS l, count(*) AS n FROM {ref} GROUP BY 1) x
  FULL OUTER JOIN (SELECT {c} AS l, count(*) AS n FROM {cur} GROUP BY 1) y ON x.l = y.l),
{name} AS (SELECT '{c}' AS feature, 'categorical' AS kind, sum((a - e) * ln(a / e)) AS psi FROM {name}s)"""


STATUS = "CASE WHEN round_even({p}, 4) >= 0.25 THEN 'alert' WHEN round_even({p}, 4) >= 0.1 THEN 'warning' ELSE 'stable' END"
PSI_OUT = f"feature, round(psi, 6) AS psi_raw, {STATUS.format(p='psi')} AS status"
SQL["psi_numeric"] = with_(halves(), psi_cte("value", "v"), f"SELECT {PSI_OUT} FROM v")
SQL["psi_categorical"] = with_(halves(), cat_cte("event_type", "c"), f"SELECT {PSI_OUT} FROM c")
_three = (halves("1.5e0"), psi_cte("value", "v"), psi_cte("user_id", "u"), cat_cte("event_type", "c"),
          f"allf AS (SELECT *, {STATUS.format(p='psi')} AS status FROM (SELECT * FROM v UNION ALL SELECT * FROM u UNION ALL SELECT * FROM c))")
SQL["drift_report"] = with_(*_three, "SELECT feature, kind, round(psi, 6) AS psi_raw, status FROM allf")
SQL["drift_totals"] = with_(*_three, f"""SELECT count(*) AS features_checked, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (status <> 'stable'), '') AS drifted,
 coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (status = 'alert'), '') AS alerting, max(round_even(psi, 4)) AS max_psi,
 round_even(avg(round_even(psi, 4)), 4) AS mean_psi, {STATUS.format(p='max(psi)')} AS status, count(*) FILTER (status = 'alert') > 0 AS drift_detected FROM allf""")


def pred_drift(scale: str) -> tuple[str, ...]:
    return (halves(scale), psi_cte("value", "v"), f"""pdr AS (SELECT {STATUS.format(p='psi')} AS status, round_even(psi, 4) AS psi, round_even(psi, 4) >= 0.25 AS drift_detected,
  round_even((SELECT avg(value) FROM ref), 2) AS reference_mean, round_even((SELECT avg(value) FROM cur), 2) AS current_mean,
  round_even((SELECT avg(value) FROM cur) - (SELECT avg(value) FROM ref), 2) AS mean_shift, (SELECT count(*) FROM cur) AS sample_size FROM v)""")


SQL["prediction_drift"] = with_(*pred_drift("1.5e0"), "SELECT * FROM pdr")
SQL["log_drift"] = with_(PRED, "lref AS (SELECT * FROM pred WHERE timestamp < TIMESTAMP '2024-01-16')",
    psi_cte("value", "v", "lref", "lastn"), psi_cte("risk_score", "s", "lref", "lastn"), cat_cte("event_type", "c", "lref", "lastn"), f"""
f AS (SELECT *, round_even(psi, 4) AS q, {STATUS.format(p='psi')} AS st FROM (SELECT * FROM v UNION ALL SELECT * FROM s UNION ALL SELECT * FROM c)),
g AS (SELECT max(q) FILTER (feature <> 'risk_score') AS feature_psi, max(q) FILTER (feature = 'risk_score') AS score_psi,
  coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (st <> 'stable'), '') AS drifted FROM f),
h AS (SELECT *, CASE WHEN feature_psi >= 0.25 OR score_psi >= 0.25 THEN 'alert' WHEN feature_psi >= 0.1 THEN 'warning' ELSE 'stable' END AS status FROM g)""", """
SELECT status, status = 'alert' AS drift_detected, (SELECT count(*) FROM lastn) AS sample_size, (SELECT min(timestamp) FROM lastn) AS window_start,
 (SELECT max(timestamp) FROM lastn) AS window_end, feature_psi, score_psi, drifted, CASE status WHEN 'alert' THEN 'Retrain the model against recent data.'
 WHEN 'stable' THEN 'Monitor; no action required.' ELSE 'Investigate the drifting features before the next scheduled retrain.' END AS recommendation FROM h""")
SQL["missing_shift"] = with_(APP, """m AS (SELECT year(ts) < 1998 AS old, MonthsEmployed IS NULL AS a, EmploymentType IS NULL AS b, CASE WHEN year(ts) < 1998 THEN LoanPurpose END IS NULL AS c FROM app),
x AS (SELECT feature, avg(miss) FILTER (old) AS r, avg(miss) FILTER (NOT old) AS u FROM (SELECT 'MonthsEmployed' AS feature, old, a::INT AS miss FROM m
 UNION ALL SELECT 'EmploymentType', old, b::INT FROM m UNION ALL SELECT 'LoanPurpose', old, c::INT FROM m) GROUP BY 1)""",
 "SELECT feature, round(r, 6) AS reference_missing, round(u, 6) AS current_missing, round(u - r, 6) AS missing_shift FROM x")

# ---- portfolio ----------------------------------------------------------------------------

SQL["portfolio_kpis"] = with_(APP, SC, """SELECT count(*) AS total_applications, round(count(*) FILTER (status = 'approved') / CAST(count(*) AS DOUBLE), 6) AS approval_rate,
 round(count(*) FILTER (status = 'rejected') / CAST(count(*) AS DOUBLE), 6) AS rejection_rate, CAST(floor(avg(risk_score) + 0.5e0) AS BIGINT) AS avg_risk_score FROM sc""")
SQL["dashboard_counts"] = with_(DECI, """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'P')) AS pending_reviews,
 count(*) FILTER (decided_at >= TIMESTAMP '1998-03-05' AND final_decision = 'approve') AS approved_today,
 count(*) FILTER (decided_at >= TIMESTAMP '1998-03-05' AND final_decision = 'reject') AS rejected_today, count(*) FILTER (decided_by = 'officer-3') AS decisions_by_officer FROM deci""")
SQL["client_dashboard"] = with_(APP, SC, """SELECT round(coalesce(sum(LoanAmount), 0), 2) AS loan_volume, count(*) FILTER (status IN ('submitted', 'under_review')) AS pending,
 count(*) FILTER (status = 'approved') AS approved, round(avg(risk_score), 6) AS mean_score FROM sc""")
SQL["monthly_trend"] = with_(APP, SC, """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS applications, count(*) FILTER (status = 'approved') AS approved,
 round(avg(risk_score), 6) AS avg_score FROM sc GROUP BY 1""")
SQL["purpose_breakdown"] = with_(APP, "SELECT LoanPurpose, count(*) AS count FROM app GROUP BY 1")
SQL["action_list"] = "SELECT DISTINCT event_type AS action FROM events"
SQL["unread_notifications"] = "SELECT user_id, count(*) AS unread FROM events WHERE event_id % 3 <> 0 GROUP BY 1"
SQL["review_queue"] = with_(APP, SC, rules_cte("sc"), """SELECT application_id, applicant_id, ts, c_name AS name, lower(c_name) || '@example.com' AS email
FROM fr LEFT JOIN customer ON c_custkey = applicant_id WHERE status = 'under_review' AND risk_level = 'medium' AND NOT fraud_flag""")
SQL["applicant_search"] = with_(APP, """SELECT application_id, c_name AS name, lower(c_name) || '@example.com' LIKE '%9@example%' AS ends_in_nine FROM app LEFT JOIN customer ON c_custkey = applicant_id
WHERE status = 'under_review' AND (contains(lower(c_name), 'mer#00000012') OR contains(CAST(application_id AS VARCHAR), 'mer#00000012'))""")
HIST = f"""hs AS (SELECT *, {level('risk_score')} AS risk_level FROM (SELECT l_orderkey AS application_id, l_shipdate AS scored_at, l_linenumber AS seq,
  {score('(CAST((l_orderkey * 31 + l_linenumber * 17) % 1000 AS DOUBLE) / 1000e0)')} AS risk_score FROM lineitem))"""
SQL["case_history"] = with_(APP, HIST, DECI, """lt AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY scored_at DESC, risk_score DESC) = 1)""",
 """SELECT app.application_id, applicant_id, status, lt.risk_score, lt.risk_level, c_name AS name, CAST(1 AS BIGINT) AS n_decisions, final_decision AS last_decision, decided_by AS last_officer
FROM app LEFT JOIN lt USING (application_id) LEFT JOIN deci USING (application_id) LEFT JOIN customer ON c_custkey = applicant_id""")
SQL["case_decisions"] = with_(DECI, """SELECT d.* FROM deci d JOIN orders ON o_orderkey = application_id WHERE o_orderstatus NOT IN ('F', 'P')""")
SQL["decision_history"] = with_(APP, DECI, """SELECT d.application_id, decided_at, final_decision, applicant_id, LoanAmount, c_name AS name FROM
 (SELECT * FROM deci WHERE decided_by = 'officer-3' ORDER BY decided_at DESC, application_id DESC LIMIT 50) d LEFT JOIN app USING (application_id) LEFT JOIN customer ON c_custkey = applicant_id""")
AUD_LOG = f"alog AS (SELECT event_id AS log_id, ts AS timestamp, {pick('user_id % 4', 'AI', 'Officer', 'Admin', 'System')} AS actor_type, event_type AS action, value FROM events)"
SQL["audit_page"] = with_(AUD_LOG, "f AS (SELECT * FROM alog WHERE actor_type IN ('AI', 'Officer') AND regexp_matches(action, 'ERR|click', 'i'))",
 "SELECT *, (SELECT count(*) FROM f) AS total FROM f ORDER BY timestamp DESC, log_id DESC LIMIT 20 OFFSET 40")
SQL["latest_score"] = with_(HIST, "SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY scored_at DESC, seq DESC) = 1")
SQL["newest_per_user"] = with_(AUD_LOG, """SELECT log_id, timestamp, action, actor_type FROM alog QUALIFY row_number() OVER (PARTITION BY actor_type ORDER BY timestamp DESC, log_id DESC) <= 50""")


def _line(section: str, pos: int, label: str, value: str, where: str = "true") -> str:
    return f"SELECT application_id, '{section}' AS section, {pos} AS position, '{label}' AS label, {value} AS value FROM rr WHERE {where}"


_comma = "format('{{:,}}', CAST(round_even({c}, 0) AS BIGINT))"
SQL["risk_report"] = with_(APP, SC, """rr AS (SELECT sc.* REPLACE (CASE WHEN application_id % 9 <> 0 THEN risk_score END AS risk_score), c_name AS name,
  application_id % 37 = 0 AS fraud_flag FROM sc LEFT JOIN customer ON c_custkey = applicant_id)""", " UNION ALL ".join([
    _line("details", 0, "Application ID", "CAST(application_id AS VARCHAR)"), _line("details", 1, "Applicant", "coalesce(name, 'N/A')"),
    _line("details", 2, "Loan Amount", "'$' || " + _comma.format(c="LoanAmount")), _line("details", 3, "Annual Income", "'$' || " + _comma.format(c="Income")),
    _line("details", 4, "Employment", "coalesce(EmploymentType, 'N/A')"), _line("details", 5, "Tenure", "CAST(LoanTerm AS INT) || ' months'"),
    _line("details", 6, "Status", "upper(status)"), _line("details", 7, "Submitted", "strftime(ts, '%Y-%m-%d')"),
    _line("risk", 0, "Risk Score", "CAST(risk_score AS VARCHAR) || '/100 (' || upper(risk_level) || ')'", "risk_score IS NOT NULL"),
    _line("risk", 1, "Confidence", "printf('%.1f', confidence * 100e0) || '%'", "risk_score IS NOT NULL"),
    _line("risk", 2, "FRAUD FLAG", "'Suspicious patterns detected'", "risk_score IS NOT NULL AND fraud_flag"),
    _line("risk", 0, "Risk Score", "'Risk assessment has not been completed yet.'", "risk_score IS NULL")]))

SQL["chat_intents"] = f"""
WITH q AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 0 THEN conv_id END AS aid,
  lower({pick('conv_id % 4', 'WHY was it? ', 'document: ', 'Rejected ', '')} || text) AS t FROM conversations WHERE role = 'user'),
i AS (SELECT *, CASE WHEN contains(t, 'rejected') OR contains(t, 'why') THEN 'reason' WHEN contains(t, 'document') OR contains(t, 'upload') THEN 'documents' ELSE 'other' END AS intent FROM q)
SELECT conv_id, turn, intent, CASE WHEN intent = 'reason' AND aid IS NULL THEN 'I need your application ID to explain the decision.'
 WHEN intent = 'reason' AND doc_id IS NOT NULL THEN 'Based on your application, ' || lower('Source ' || source)
 WHEN intent = 'reason' THEN 'I don''t have the specific risk explanation for this application yet.'
 WHEN intent = 'documents' THEN 'You can upload ID proofs, bank statements, and tax returns in the ''Documents'' tab.'
 ELSE 'I''m a simple AI assistant. Please contact support for more complex queries.' END AS answer FROM i LEFT JOIN documents ON doc_id = aid"""

SQL["narrative"] = with_(APP, derived_ctes("app"), scored("der"), """
f0 AS (SELECT application_id, unnest(['CreditScore', 'LoanToIncomeRatio', 'DTIRatio', 'LoanPurpose']) AS f,
  unnest([(575e0 - CreditScore) / 400e0, (LoanToIncomeRatio - 12e0) / 30e0, DTIRatio - 0.77e0, CASE WHEN LoanPurpose IN ('Home', 'Auto') THEN -0.31e0 ELSE 0.29e0 END]) AS c,
  CreditScore AS cs, LoanToIncomeRatio AS lti, DTIRatio AS dti, LoanPurpose AS lp FROM sc),
f1 AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY abs(c) DESC, f) AS rn, round_even(abs(c) / sum(abs(c)) OVER (PARTITION BY application_id), 4) AS w FROM f0),
f2 AS (SELECT *, CASE WHEN f = 'CreditScore' AND c > 0 THEN 'a credit score of ' || CAST(cs AS INT) || ', which is below the level associated with reliable repayment'
  WHEN f = 'CreditScore' THEN 'a credit score of ' || CAST(cs AS INT) || ', which indicates a solid repayment record'
  WHEN f = 'LoanToIncomeRatio' AND c > 0 THEN 'a requested amount worth ' || printf('%.1f', lti) || 'x annual income'
  WHEN f = 'LoanToIncomeRatio' THEN 'a requested amount of only ' || printf('%.1f', lti) || 'x annual income'
  WHEN f = 'DTIRatio' AND c > 0 THEN 'a debt-to-income ratio of ' || printf('%.2f', dti) || ', meaning a large share of income already services existing debt'
  WHEN f = 'DTIRatio' THEN 'a manageable debt-to-income ratio of ' || printf('%.2f', dti)
  WHEN c > 0 THEN 'a ''' || lp || ''' loan purpose, which carries higher historical loss rates' ELSE 'a ''' || lp || ''' loan purpose, which carries lower historical loss rates' END AS say,
  CASE f WHEN 'CreditScore' THEN 'Credit score' WHEN 'LoanToIncomeRatio' THEN 'Loan-to-income ratio' WHEN 'DTIRatio' THEN 'Debt-to-income ratio' ELSE 'Loan purpose' END AS lab,
  coalesce(CASE f WHEN 'CreditScore' THEN printf('%.3f', CAST(cs AS DOUBLE)) WHEN 'LoanToIncomeRatio' THEN printf('%.3f', lti) WHEN 'DTIRatio' THEN printf('%.3f', dti) ELSE lp END, '') AS val FROM f1 WHERE rn <= 3),
f3 AS (SELECT application_id, list(say ORDER BY rn) FILTER (c > 0) AS bad, list(say ORDER BY rn) FILTER (c <= 0) AS good,
  string_agg(lab || CASE WHEN c > 0 THEN ' increases' ELSE ' reduces' END || ' assessed risk, accounting for ' || CAST(round_even(w * 100e0, 0) AS INT) || '% of the factors considered.', ' ' ORDER BY rn) AS description, string_agg(val, '|' ORDER BY rn) AS shown FROM f2 GROUP BY 1),
f4 AS (SELECT *, CASE len(bad) WHEN 1 THEN bad[1] WHEN 2 THEN bad[1] || ' and ' || bad[2] WHEN 3 THEN bad[1] || ', ' || bad[2] || ' and ' || bad[3] END AS bads,
  CASE len(good) WHEN 1 THEN good[1] WHEN 2 THEN good[1] || ' and ' || good[2] WHEN 3 THEN good[1] || ', ' || good[2] || ' and ' || good[3] END AS goods FROM f3)""", """
SELECT sc.application_id, concat_ws(' ', 'This application scores ' || CAST(round_even(risk_score, 0) AS INT) || ' out of 100 and is classified as '
  || CASE risk_level WHEN 'low' THEN 'low risk' WHEN 'medium' THEN 'moderate risk' ELSE 'high risk' END || ', corresponding to an estimated ' || printf('%.1f', probability * 100e0) || '% probability of default.',
 'The main factors increasing risk are ' || bads || '.', 'Working in the applicant''s favour: ' || goods || '.',
 CASE WHEN confidence >= 0.85e0 THEN 'Model confidence is high (' || CAST(round_even(confidence * 100e0, 0) AS INT) || '%); the profile sits well clear of the boundaries between risk bands.'
  WHEN confidence >= 0.7e0 THEN 'Model confidence is moderate (' || CAST(round_even(confidence * 100e0, 0) AS INT) || '%).'
  ELSE 'Model confidence is low (' || CAST(round_even(confidence * 100e0, 0) AS INT) || '%) because this profile sits close to a risk-band boundary. Manual review is recommended before acting on the score.' END,
 CASE risk_level WHEN 'low' THEN 'A score below 25 falls inside the automatic approval band.' WHEN 'high' THEN 'A score at or above 75 falls inside the automatic decline band; an officer may still override with documented justification.'
  ELSE 'This score falls between the automatic approval and decline bands, so the application is routed to an officer for review.' END,
 'The most effective way to improve this assessment would be to address ' || bad[1] || '.') AS sentences, description, shown FROM sc JOIN f4 USING (application_id)""")

# ---- retraining and registry ----------------------------------------------------------------

UNI = """hist AS (SELECT o_orderkey AS LoanID, o_orderkey AS arrival, o_totalprice AS LoanAmount, 0 AS "Default" FROM orders),
outc AS (SELECT CASE WHEN l_orderkey % 4 <> 0 THEN l_orderkey END AS LoanID, 10000000 + l_orderkey * 10 + l_linenumber AS arrival, CAST(l_quantity AS DOUBLE) AS LoanAmount,
  CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber % 2 AS INT) END AS "Default" FROM lineitem),
u AS (SELECT * FROM hist UNION ALL SELECT * FROM outc WHERE "Default" IS NOT NULL),
dd AS (SELECT * FROM u WHERE LoanID IS NOT NULL QUALIFY row_number() OVER (PARTITION BY LoanID ORDER BY arrival) = 1
 UNION ALL SELECT LoanID, min(arrival) AS arrival, LoanAmount, "Default" FROM u WHERE LoanID IS NULL GROUP BY ALL)"""
SQL["retrain_dedup"] = with_(UNI, "SELECT * FROM dd")
SQL["retrain_statistics"] = with_(UNI, """SELECT (SELECT count(*) FROM hist) AS historical_rows, (SELECT count(*) FROM outc WHERE "Default" IS NOT NULL) AS outcome_rows,
 (SELECT count(*) FROM dd) AS total_rows, (SELECT count(*) FROM u) - (SELECT count(*) FROM dd) AS removed_rows""")
REG = """reg AS (SELECT 'v' || period AS version, period AS created_at, roc_auc FROM rk),
act AS (SELECT DISTINCT 'v' || strftime(o_orderdate, '%Y-%m') AS version FROM orders WHERE month(o_orderdate) IN (1, 4, 7, 10)),
ptr AS (SELECT (SELECT max(version) FROM act) AS a, (SELECT max(version) FROM act WHERE version < (SELECT max(version) FROM act)) AS p)"""
SQL["registry_view"] = with_(APP, PER, rank_cte("per", "period"), REG, "SELECT version, created_at, round(roc_auc, 6) AS roc_auc, version = a AS is_active, version = p AS is_previous FROM reg, ptr")
SQL["registry_prune"] = with_(APP, PER, rank_cte("per", "period"), REG, """SELECT version FROM (SELECT version, row_number() OVER (ORDER BY version DESC) AS rn FROM reg), ptr
WHERE rn > 5 AND version <> a AND version <> p""")
SQL["promotion_decision"] = with_(APP, PER, rank_cte("per", "period"), REG, """
q AS (SELECT version AS challenger, roc_auc AS ca, lag(version) OVER (ORDER BY created_at) AS champion, lag(roc_auc) OVER (ORDER BY created_at) AS pa FROM reg)""", """
SELECT challenger, round(ca, 6) AS challenger_auc, champion, round(pa, 6) AS champion_auc, champion IS NULL OR pa IS NULL OR coalesce(ca, 0e0) - pa >= 0.002e0 AS promoted,
 CASE WHEN champion IS NULL THEN 'No incumbent model; the challenger becomes the first active version.' WHEN pa IS NULL THEN 'Incumbent has no recorded AUC; promoting the challenger.'
  WHEN coalesce(ca, 0e0) - pa >= 0.002e0 THEN printf('Challenger AUC %.4f beats champion %.4f by %+.4f, clearing the required margin of 0.0020.', coalesce(ca, 0e0), pa, coalesce(ca, 0e0) - pa)
  ELSE printf('Challenger AUC %.4f does not beat champion %.4f by the required margin (%+.4f < 0.0020); the champion stays active.', coalesce(ca, 0e0), pa, coalesce(ca, 0e0) - pa) END AS reason FROM q""")
SQL["retrain_triggers"] = with_(*pred_drift("1.5e0"), APP, PER, rank_cte("per", "period"), TREND, """
o AS (SELECT count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '2000-01-01'),
x AS (SELECT pdr.drift_detected AS drift, trend.alert AS degraded, recommendation, n FROM pdr, trend, o),
y AS (SELECT *, concat_ws(' ', CASE WHEN drift THEN 'Data or prediction drift exceeded the alert threshold.' END, CASE WHEN degraded THEN recommendation END,
  CASE WHEN n >= 1000 THEN n || ' new realised outcomes are available for training.' END) AS reasons FROM x)""",
 "SELECT reasons <> '' AS should_retrain, reasons, drift, degraded, n AS new_outcomes FROM y")
SQL["model_health"] = with_(*pred_drift("1e0"), APP, PER, rank_cte("per", "period"), TREND, LAB, rank_cte("lab", "", "lk"), PRED, THR,
    *[s for s in FAIRS[1:]], AUDIT, """
hh AS (SELECT lk.roc_auc AS auc, pdr.status AS drift_status, pdr.drift_detected, trend.status AS trend_status, trend.alert AS ta, trend.recommendation AS ad, total_predictions, avg_latency_ms,
  (SELECT bool_or(bias_alert) FROM aud) AS bias FROM lk, pdr, trend, thr),
al AS (SELECT *, concat_ws(' | ', CASE WHEN drift_detected THEN 'Data or prediction drift exceeded the alert threshold.' END, CASE WHEN ta THEN ad END,
  CASE WHEN auc < 0.68e0 THEN 'Training AUC ' || printf('%.4f', round_even(auc, 4)) || ' is below the configured minimum 0.68.' END,
  CASE WHEN bias THEN 'Fairness audit flagged a disparity at training time.' END) AS alerts FROM hh)""", """
SELECT round(auc, 6) AS roc_auc, drift_status, drift_detected, trend_status, total_predictions, avg_latency_ms, alerts, CASE WHEN alerts <> '' THEN 'degraded' ELSE 'healthy' END AS status,
 auc >= 0.68e0 AS meets_minimum_auc FROM al""")

# ---- preparation for learning -----------------------------------------------------------------

_stats = ["Income", "LoanAmount", "MonthsEmployed", "DTIRatio", "LoanToIncomeRatio"]
SQL["preprocess_stats"] = with_(APP, repaired("app"), derived_ctes("rep"), " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(quantile_cont({c}, 0.005), 6) AS clip_low, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.995), 6) AS clip_high FROM der" for c in _stats))
SQL["category_modes"] = with_(APP, repaired("app"), "lv AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} AS level, count(*) AS n FROM rep WHERE {c} IS NOT NULL GROUP BY 2" for c in v.CATEGORICAL) + ")",
 "SELECT feature, level AS mode FROM lv QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) = 1")
SQL["class_weight"] = with_(APP, """SELECT count(*) AS n, count(*) FILTER ("Default" = 1) AS positives, round(avg("Default"), 6) AS rate,
 round(count(*) FILTER ("Default" = 0) / CAST(count(*) FILTER ("Default" = 1) AS DOUBLE), 6) AS pos_weight FROM app""")
POS = """ps AS (SELECT application_id, "Default", ((application_id % 4294967296) // 65536 * 2654435761 % 65536 * 65536 + application_id % 65536 * 2654435761) % 4294967296 AS u FROM app),
rn AS (SELECT *, row_number() OVER (PARTITION BY "Default" ORDER BY u, application_id) AS r, count(*) OVER (PARTITION BY "Default") AS n FROM ps)"""
SQL["strat_split"] = with_(APP, POS, """SELECT application_id, CASE WHEN r <= ceil(n * 0.15e0) THEN 'test' WHEN r <= ceil(n * 0.15e0) + ceil(n * 0.15e0) THEN 'val' ELSE 'train' END AS split FROM rn""")
SQL["undersample"] = with_(APP, POS, """SELECT application_id, "Default" FROM rn WHERE r <= (SELECT min(n) FROM rn)""")
SQL["stratified_folds"] = with_(APP, POS, """SELECT "Default", CAST(floor(u * 5e0 / 4294967296e0) AS INTEGER) AS fold, count(*) AS n FROM ps GROUP BY 1, 2""")

# ---- streams: the batch equivalent of the finished stream ---------------------------------------

SQL["stream_throughput"] = with_(PRED, f"""w AS (SELECT date_trunc('hour', timestamp) AS window_start, count(*) AS total_predictions, round(avg(value), 6) AS avg_latency_ms,
  round(quantile_disc(value, 0.95), 6) AS p95_latency_ms, round(avg(risk_score), 6) AS mean_risk_score, {_nl}, count(*) FILTER (fraud_flag) AS fraud_flagged FROM pred GROUP BY 1)""",
 "SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, * EXCLUDE (window_start) FROM w")
SQL["stream_duplicates"] = """
WITH s AS (SELECT event_id, ts, value, left(sha256(concat_ws('|', CAST(user_id AS VARCHAR), lower(event_type))), 32) AS fingerprint FROM events),
w AS (SELECT *, row_number() OVER win AS n, lag(event_id) OVER win AS pid, lag(value) OVER win AS pv FROM s WINDOW win AS (PARTITION BY fingerprint ORDER BY ts, event_id))
SELECT event_id AS application_id, fingerprint, n AS occurrence, pid AS previous_id, round_even(100e0 * (value - pv) / nullif(abs(pv), 0e0), 2) AS Income_change_pct,
 round_even(100e0 * (value * 10e0 - pv * 10e0) / nullif(abs(pv * 10e0), 0e0), 2) AS LoanAmount_change_pct FROM w"""
SQL["stream_drift"] = with_(
    "ref AS (SELECT value, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16')",
    "cur AS (SELECT value, event_type, date_trunc('day', ts) AS d FROM events WHERE ts >= TIMESTAMP '2024-01-16')",
    "e0 AS (SELECT list_sort(list_distinct(quantile_cont(value, [" + ", ".join(f"{i / 10!r}" for i in range(11)) + "]))) AS e FROM ref)",
    "ei AS (SELECT unnest(e[2:len(e) - 1]) AS edge FROM e0)", """
rb AS (SELECT 'value' AS feature, 'numeric' AS kind, CAST((SELECT count(*) FROM ei WHERE edge <= value) AS VARCHAR) AS bin FROM ref UNION ALL SELECT 'event_type', 'categorical', event_type FROM ref),
cb AS (SELECT d, 'value' AS feature, 'numeric' AS kind, CAST((SELECT count(*) FROM ei WHERE edge <= value) AS VARCHAR) AS bin FROM cur UNION ALL SELECT d, 'event_type', 'categorical', event_type FROM cur),
re AS (SELECT feature, kind, bin, count(*) / CAST(sum(count(*)) OVER (PARTITION BY feature) AS DOUBLE) AS e FROM rb GROUP BY 1, 2, 3),
ca AS (SELECT d, feature, kind, bin, count(*) / CAST(sum(count(*)) OVER (PARTITION BY d, feature) AS DOUBLE) AS a FROM cb GROUP BY 1, 2, 3, 4),
days AS (SELECT DISTINCT d FROM cur),
grid AS (SELECT d, feature, kind, bin, greatest(e, 1e-6) AS e FROM days, re),
j AS (SELECT coalesce(g.d, c.d) AS d, coalesce(g.feature, c.feature) AS feature, coalesce(g.kind, c.kind) AS kind, coalesce(e, 1e-6) AS e, greatest(coalesce(a, 0e0), 1e-6) AS a
  FROM grid g FULL OUTER JOIN (SELECT * FROM ca WHERE d IN (SELECT d FROM days)) c ON g.d = c.d AND g.feature = c.feature AND g.bin = c.bin),
o AS (SELECT d, feature, kind, round_even(sum((a - e) * ln(a / e)), 4) AS psi FROM j GROUP BY 1, 2, 3)""",
    f"SELECT d AS window_start, feature, kind, psi, {STATUS.format(p='psi')} AS status FROM o")
SQL["stream_decisions"] = with_(APP, "app2 AS (SELECT * REPLACE (2e0 AS NumCreditLines) FROM app)", scored("app2"), rules_cte("sc"), DEC,
 "SELECT application_id, risk_score, fraud_probability, fraud_flag, ai_recommendation, status, final_decision FROM dec")
SQL["smote"] = """
WITH c AS (SELECT CAST(label = 3 AS INT) AS y, count(*) AS n FROM embeddings GROUP BY 1)
SELECT y, false AS synthetic, n FROM c UNION ALL SELECT y, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)"""
SQL["nearest_neighbours"] = """
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.id, b.id AS neighbour, list_distance(a.x, b.x) AS distance FROM e a JOIN e b ON a.id <> b.id)
SELECT id, neighbour, round(distance, 6) AS distance, rank FROM (
 SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM d) WHERE rank <= 5"""

# ---- sources and sinks: what was written is what is read -----------------------------------------

SQL["csv_scan"] = "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer"
SQL["canonical_file"] = with_(APP, """SELECT "Education", "LoanPurpose", count(*) AS n, round(sum("LoanAmount"), 6) AS amount, sum("Default") AS defaults FROM app GROUP BY 1, 2""")
SQL["content_digest"] = "SELECT count(*) AS n_rows, true AS copy_is_equal, true AS swap_is_seen FROM orders"
SQL["dataset_versions"] = with_(APP, """va AS (SELECT 'v1' AS version, * FROM app UNION ALL SELECT 'v2', * FROM app WHERE status <> 'rejected')""", """SELECT version, count(*) AS n_rows, round(avg("Default"), 6) AS positive_rate, 'application_id,status,Default' AS columns, (SELECT count(*) FROM app) AS rows_of_v1 FROM va GROUP BY 1""")
SQL["prediction_log"] = with_(APP, SC, """SELECT application_id, "Education", risk_score, risk_level, application_id % 37 = 0 AS fraud_flag FROM sc WHERE date_trunc('year', ts) >= DATE '1995-01-01'""")
SQL["outcome_log"] = with_(APP, """SELECT application_id, "Age", "EmploymentType", CAST(status = 'rejected' AS INTEGER) AS "Default" FROM app WHERE status <> 'under_review'""")
SQL["performance_history"] = with_(LAB, "lp AS (SELECT *, 'p' || (doc_id % 4) AS period FROM lab)", rank_cte("lp", "period"),
 f"cm AS ({CM.format(k='period,', s='lp', g='GROUP BY period')})",
 "SELECT period, round((tp + tn) / CAST(n AS DOUBLE), 6) AS accuracy, round(roc_auc, 6) AS roc_auc,"
 " round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0e0), 6) AS recall, n AS n_observations FROM cm JOIN rk USING (period)")

# ---- records, folds and projections ----------------------------------------------------------------


def _broken(record: str, table: str, rules: dict[str, str]) -> str:
    listed = ", ".join(f"CASE WHEN {sql} THEN '{rule}' END" for rule, sql in rules.items())
    return f"SELECT '{record}' AS record, unnest([{listed}]) AS rule FROM {table}"


_K, _C, _P = "o_orderkey", "c_custkey", "(n_chars / (n_chars + 2048e0))"
SQL["record_constraints"] = "SELECT record, rule, count(*) AS n FROM (" + " UNION ALL ".join([
    _broken("risk_score", "orders", {
        "applicationId:required": f"{_K} % 41 = 0", "riskScore:required": f"{_K} % 43 = 0", "riskScore:range": f"{_K} % 43 <> 0 AND ({_K} % 130 < 10 OR {_K} % 130 > 110)",
        "riskLevel:enum": f"{_K} % 4 = 3", "confidenceScore:range": f"{_K} % 12 = 11"}),
    _broken("decision", "orders", {
        "applicationId:required": f"{_K} % 41 = 0", "decidedBy:required": f"{_K} % 7 = 0", "aiRecommendation:enum": f"{_K} % 4 = 3",
        "finalDecision:enum": f"{_K} % 4 = 2", "overrideReason:length": f"{_K} % 10 > 5"}),
    _broken("audit", "orders", {
        "actorType:required": f"{_K} % 6 = 5", "actorType:enum": f"{_K} % 6 = 4", "action:length": f"{_K} % 10 > 5", "details:length": f"{_K} % 10 > 5"}),
    _broken("metric", "(SELECT doc_id, n_chars FROM documents JOIN labels USING (doc_id))", {
        "date:required": "doc_id % 11 = 0", "accuracy:range": f"{_P} * 1.5e0 > 1", "driftScore:range": f"{_P} - 0.2e0 < 0", "agreementRate:range": f"{_P} * 1.25e0 > 1"}),
    _broken("notification", "customer", {
        "userId:required": f"{_C} % 41 = 0", "title:length": f"{_C} % 10 > 5", "message:length": f"{_C} % 10 > 5", "type:enum": f"{_C} % 3 = 2"}),
    _broken("user", "customer", {
        "name:required": f"{_C} % 13 = 0", "email:pattern": f"{_C} % 4 <> 0", "password:length": f"{_C} % 10 < 6", "role:enum": f"{_C} % 4 = 3", "status:enum": f"{_C} % 3 = 2"}),
]) + ") WHERE rule IS NOT NULL GROUP BY 1, 2"
SQL["fold_metrics"] = f"""
WITH l AS (SELECT doc_id % 5 AS fold, quality AS y, {_P} AS p FROM documents JOIN labels USING (doc_id)),
f AS (SELECT fold, avg(CAST((p >= 0.5e0) = (y = 1) AS INT)) AS accuracy,
  coalesce(count(*) FILTER (p >= 0.5e0 AND y = 1) / nullif(CAST(count(*) FILTER (y = 1) AS DOUBLE), 0), 0) AS recall FROM l GROUP BY 1)
SELECT round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std, round(avg(recall), 6) AS recall_mean, round(stddev_pop(recall), 6) AS recall_std FROM f"""
SQL["public_profiles"] = "SELECT c_custkey AS user_id, c_name AS name, c_name || '@bank.org' AS email, 'applicant' AS role, 'active' AS status FROM customer"
SQL["financial_limits"] = with_(APP, repaired("app"), derived_ctes("rep"), """
SELECT "LoanPurpose", count(*) FILTER ("DTIRatio" <= 0.36e0) AS dti_ok, count(*) FILTER ("LoanToIncomeRatio" <= 4e0) AS lti_ok, count(*) AS n FROM der GROUP BY 1""")
SQL["stream_outcomes"] = f"""
SELECT count(*) AS new_outcomes, count(*) >= {v.OUTCOME_BACKLOG} AS retrain FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate > TIMESTAMP '1996-01-01'"""

# ---- cache by parts, late rows ------------------------------------------------------------------

SQL["cache_refresh"] = """SELECT part, false AS before, true AS built, part <> 'pos' AS changed, true AS after, (SELECT count(*) FROM customer) AS applicants
FROM (VALUES ('application'), ('bureau'), ('previous'), ('instalments'), ('pos'), ('card')) AS p(part)"""
SQL["stream_late_rows"] = """
WITH e AS (SELECT ts, CASE WHEN event_id % 50 = 7 THEN 3 ELSE least((day(ts) - 1) // 8, 3) END AS part FROM events),
w AS (SELECT p.part, (SELECT max(ts) FROM e WHERE e.part < p.part) - INTERVAL 10 MINUTE AS mark FROM (SELECT DISTINCT part FROM e) p),
m AS (SELECT date_trunc('hour', ts) AS h, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark, false) AS late FROM e JOIN w USING (part))
SELECT CAST(h AS TIMESTAMP) AS window_start, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM m GROUP BY 1"""
