"""The registered queries as SQL for DuckDB over the same tables."""

from __future__ import annotations

from .. import rules
from .ledger import NARRATIONS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def says(column: str, words) -> str:
    """Whether upper-case, collapsed text holds one of the words."""
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


UP = r"trim(regexp_replace(upper(coalesce({0}, '')), '\s+', ' ', 'g'))"
OWN = f"({says('t', rules.CHANNEL)} AND {says('t', rules.SELF)})"
EXPLICIT = says("t", rules.EXPLICIT_BILL)
BILL = f"""({says('t', rules.TELE_CREDIT)} OR ({says('t', rules.CARD_PAYMENT)} AND CASE
    WHEN account_type = 'credit_card' AND direction = 'credit' THEN {EXPLICIT} OR contains(t, 'AUTOPAY')
    WHEN direction = 'credit' THEN {EXPLICIT}
    ELSE {EXPLICIT} OR (contains(t, 'CARD PAYMENT') AND ({OWN} OR {says('t', rules.BANK_TOKENS)})) OR {says('t', ('AUTOPAY', 'BILLDESK'))} END))"""
NATURE = f"""CASE WHEN direction = 'debit' THEN CASE WHEN {BILL} THEN 'transfer_internal' WHEN {says('t', rules.INVESTMENT)} THEN 'investment'
        WHEN {says('t', rules.TAX)} THEN 'tax' WHEN {OWN} THEN 'transfer_internal' ELSE 'expense' END
    WHEN {says('t', rules.REFUND)} THEN 'refund' WHEN {says('t', rules.INTEREST)} THEN 'interest_income' WHEN {says('t', rules.DIVIDEND)} THEN 'dividend_income'
    WHEN {says('t', rules.SALARY)} THEN 'income' WHEN {BILL} OR {OWN} THEN 'transfer_internal' WHEN account_type = 'credit_card' THEN 'refund' ELSE 'income' END"""
LEDGER = f"""base AS (
    SELECT o_orderkey AS txn_id, o_custkey % 50 AS user_id, 'XX' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS account_masked, o_orderdate::DATE AS transaction_date,
        o_totalprice::DECIMAL(14,2) AS amount, CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS direction,
        CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'credit_card' ELSE 'savings' END AS account_type, c_mktsegment AS bank_name,
        CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS category_name,
        {listed(NARRATIONS)}[(o_orderkey % 16)::INT + 1] || ' ' || c_name AS merchant_raw, CASE WHEN o_orderkey % 5 <> 0 THEN c_name END AS merchant_normalized,
        CASE WHEN o_orderkey % 11 = 0 THEN 'checked by hand' END AS notes, o_orderkey % 37 = 0 AS is_excluded
    FROM orders JOIN customer ON o_custkey = c_custkey),
texts AS (SELECT *, {UP.format('merchant_raw')} AS t FROM base),
ledger AS (SELECT * EXCLUDE (t), {NATURE} AS nature FROM texts),
active AS (SELECT *, strftime(transaction_date, '%Y-%m') AS ym, coalesce(nullif(merchant_normalized, ''), merchant_raw) AS merchant FROM ledger WHERE NOT is_excluded)"""
SUMMARY = """summary AS (
    SELECT user_id, ym AS year_month, coalesce(sum(amount) FILTER (nature = 'income'), 0) AS income, coalesce(sum(amount) FILTER (nature = 'expense'), 0) AS expense, count(*) AS txn_count
    FROM active GROUP BY ALL)"""
ROWS = """stmt_rows AS (
    SELECT *, user_id || '-' || account_masked || '-' || strftime(transaction_date, '%Y-%m') AS statement_id, txn_id AS seq, CASE WHEN txn_id % 101 <> 0 THEN direction = 'credit' END AS is_credit,
        CASE WHEN direction = 'credit' THEN amount ELSE -amount END AS signed FROM ledger),
walked AS (
    SELECT *, CASE WHEN txn_id % 3 <> 1 THEN 10000 + sum(signed) OVER (PARTITION BY statement_id ORDER BY transaction_date, txn_id ROWS UNBOUNDED PRECEDING) + CASE WHEN txn_id % 29 = 0 THEN 5 ELSE 0 END END AS balance_after FROM stmt_rows),
statements AS (
    SELECT statement_id, user_id, account_masked, account_type, bank_name, date_trunc('month', min(transaction_date))::DATE AS period_start, last_day(max(transaction_date)) AS period_end, count(*) AS row_count,
        10000.00 AS opening_balance, sum(signed) + 10000 + CASE WHEN (user_id + month(min(transaction_date))) % 7 = 0 THEN 50 ELSE 0 END AS closing_balance,
        CASE WHEN account_type = 'credit_card' THEN coalesce(sum(amount) FILTER (direction = 'debit'), 0) END AS total_due, last_day(max(transaction_date)) + 20 AS due_date
    FROM stmt_rows GROUP BY statement_id, user_id, account_masked, account_type, bank_name)"""
SNAPS = """snaps AS (
    SELECT statement_id, user_id, regexp_replace(lower(bank_name || '-' || account_type || '-' || account_masked), '[^a-z0-9]+', '-', 'g') AS position_key, period_end AS as_of_date,
        CASE WHEN account_type = 'credit_card' THEN abs(total_due) ELSE closing_balance END AS balance, CASE WHEN account_type = 'credit_card' THEN 'liability' ELSE 'asset' END AS entry_kind FROM statements)"""
SMS = """sms AS (
    SELECT * REPLACE (txn_id + 1000000000 AS txn_id, (transaction_date + (txn_id % 9 - 4)::INT) AS transaction_date, (amount + (txn_id % 5 - 2) * 0.60)::DECIMAL(14,2) AS amount) FROM ledger WHERE txn_id % 3 = 0)"""
FY = "transaction_date BETWEEN DATE '1999-04-01' AND DATE '2000-03-31'"
RAW = UP.format("merchant_raw")
TOTALS = f"""totals AS (
    SELECT user_id, coalesce(sum(amount) FILTER (nature = 'income' AND {says(RAW, rules.SALARY)}), 0) AS salary_income, coalesce(sum(amount) FILTER (nature = 'income' AND NOT {says(RAW, rules.SALARY)}), 0) AS other_income,
        coalesce(sum(amount) FILTER (nature = 'interest_income'), 0) AS interest_income, coalesce(sum(amount) FILTER (nature = 'dividend_income'), 0) AS dividend_income,
        coalesce(sum(amount) FILTER (nature = 'tax'), 0) AS tax_payments, coalesce(sum(amount) FILTER (nature = 'investment'), 0) AS investments, coalesce(sum(amount) FILTER (nature = 'expense'), 0) AS expenses
    FROM active WHERE {FY} GROUP BY user_id)"""
CHALLANS = says(RAW, ("CHALLAN", "ADVANCE TAX", "SELF ASSESSMENT", "INCOME TAX", "TDS"))
BUCKETS = f"""buckets AS (
    SELECT user_id, b AS bucket, sum(amount) AS amount FROM (
        SELECT user_id, amount, unnest([CASE WHEN nature = 'income' AND {says(RAW, ('SALARY', 'PAYROLL'))} THEN 'salary' END, CASE WHEN nature = 'interest_income' THEN 'interest' END,
            CASE WHEN nature = 'dividend_income' THEN 'dividend' END, CASE WHEN direction = 'debit' AND nature = 'tax' AND {CHALLANS} THEN 'tax_paid' END]) AS b
        FROM active WHERE {FY}) WHERE b IS NOT NULL GROUP BY ALL)"""
PORTAL = """portal AS (
    SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN salary_income + user_id % 4 * 60 END AS gross_salary, CASE WHEN user_id % 6 <> 0 THEN interest_income + user_id % 3 * 80 END AS interest_income,
        CASE WHEN user_id % 7 <> 0 THEN dividend_income END AS dividend_income, CASE WHEN user_id % 3 <> 0 THEN tax_payments + user_id % 2 * 3 END AS self_paid_tax, user_id % 4 * 1000 AS securities_sold FROM totals)"""
FACTS = """facts AS (
    SELECT *, user_id % 2 AS tax_form, user_id % 3 AS interest_certificate, user_id % 4 AS dividend_report, user_id % 5 AS tax_challan, user_id % 6 AS large_cash, user_id % 7 AS savings_accounts,
        interest_income - user_id % 3 * 4000 AS documented_interest, tax_payments - user_id % 4 * 600 AS documented_tax, greatest(user_id % 9 - 7, 0) AS unresolved_documents
    FROM totals JOIN (SELECT user_id, count(*) AS ledger_rows FROM ledger GROUP BY user_id) USING (user_id))"""
INCOME = """income AS (
    SELECT *, printf('%04d-%02d', fy_start, (fy_start + 1) % 100) AS fy FROM (
        SELECT *, (year(transaction_date) - CASE WHEN month(transaction_date) < 4 THEN 1 ELSE 0 END)::INT AS fy_start,
            CASE WHEN nature = 'income' AND contains(merchant_raw, 'SALARY') THEN 'salary' WHEN nature = 'interest_income' THEN 'interest' WHEN nature = 'dividend_income' THEN 'dividend' END AS bucket FROM active)
    WHERE bucket IS NOT NULL),
lines AS (SELECT txn_id AS line_id, user_id, fy, bucket, round(amount * CASE WHEN txn_id % 2 = 0 THEN 100 + txn_id % 7 ELSE 200 END / 100, 2)::DECIMAL(14,2) AS amount FROM income)"""
TAX_FACTS = f"""tax_facts AS (
    SELECT user_id, user_id % 9 <> 0 AS has_ais, user_id % 4 <> 0 AS has_26as, user_id % 3 <> 0 AS has_form16, coalesce(salary, 0) > 0 AS ais_salary, user_id % 5 = 0 AS ais_securities, coalesce(interest, 0) AS ais_interest_lines,
        user_id % 4 AS form16a_sections, user_id % 6 AS coverage_rows, n // 30 AS ledger_rows
    FROM (SELECT user_id, count(*) FILTER ({FY}) AS n FROM active GROUP BY ALL)
    LEFT JOIN (SELECT user_id, count(*) AS lines, count(*) FILTER (bucket = 'salary') AS salary, count(*) FILTER (bucket = 'interest') AS interest FROM lines WHERE fy = '1999-00' GROUP BY ALL) USING (user_id))"""
TAXPAYERS = """taxpayers AS (
    SELECT c_custkey AS user_id, (greatest(c_acctbal, 0)::DECIMAL(14,2) * 300 + (c_custkey % 13) * 450000)::DECIMAL(16,2) AS gross_salary, (c_custkey % 7) * 9000 AS interest_income, (c_custkey % 5) * 4000 AS dividend_income,
        (c_custkey % 3) * 60000 AS rental, (c_custkey % 11) * 1500 AS other_income, (c_custkey % 4) * 75000 AS stcg, (c_custkey % 6) * 90000 AS ltcg, (c_custkey % 9) * 25000 AS d80c, (c_custkey % 4) * 20000 AS d1b,
        (c_custkey % 3) * 10000 AS d2, (c_custkey % 5) * 12000 AS dself, (c_custkey % 4) * 15000 AS dparents, (c_custkey % 2) * 7000 AS d80e, (c_custkey % 3) * 2500 AS d80g, (c_custkey % 8) * 3000 AS dtta,
        (c_custkey % 6) * 50000 AS house_self, (c_custkey % 5) * 70000 AS house_let, c_custkey % 8 = 0 AS is_senior, c_custkey % 16 = 0 AS is_super FROM customer)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


ORACLE_SQL: dict[str, str] = {
    "d1_monthly_summary": with_(LEDGER, SUMMARY, select="SELECT user_id, year_month, income::DOUBLE AS income, expense::DOUBLE AS expense, (income - expense)::DOUBLE AS net, txn_count FROM summary"),
    "d1_monthly_categories": with_(LEDGER, select="SELECT user_id, ym AS year_month, coalesce(category_name, 'Uncategorized') AS category_name, sum(amount)::DOUBLE AS amount FROM active WHERE nature = 'expense' GROUP BY ALL"),
    "d1_top_merchants": with_(LEDGER, select="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, year_month ORDER BY amount DESC, merchant) AS place FROM (SELECT user_id, ym AS year_month, merchant, sum(amount)::DOUBLE AS amount, count(*) AS txn_count FROM active WHERE nature = 'expense' GROUP BY ALL)) WHERE place <= 10"),
    "d2_month_change": with_(LEDGER, SUMMARY, select="SELECT a.user_id, a.year_month, round((a.expense - b.expense)::DOUBLE / nullif(b.expense, 0)::DOUBLE * 100, 2) AS change_percent FROM summary a LEFT JOIN summary b ON a.user_id = b.user_id AND b.year_month = strftime((a.year_month || '-01')::DATE - INTERVAL 1 MONTH, '%Y-%m')"),
    "d3_spending_trend": with_(LEDGER, SUMMARY, select="SELECT u.user_id, m.year_month, coalesce(income, 0)::DOUBLE AS income, coalesce(expense, 0)::DOUBLE AS expense, coalesce(income - expense, 0)::DOUBLE AS net, coalesce(txn_count, 0) AS txn_count FROM (SELECT DISTINCT user_id FROM summary) u CROSS JOIN (SELECT strftime(unnest(range(TIMESTAMP '2000-09-01', TIMESTAMP '2001-08-02', INTERVAL 1 MONTH)), '%Y-%m') AS year_month) m LEFT JOIN summary s ON s.user_id = u.user_id AND s.year_month = m.year_month"),
    "d4_budget_usage": with_(LEDGER, """budgets AS (SELECT user_id * 2 AS budget_id, user_id, NULL AS category_name, 'yearly' AS period, (3000000 + user_id * 1000)::DECIMAL(24,2) AS amount_limit FROM (SELECT DISTINCT user_id FROM ledger)
        UNION ALL SELECT user_id * 2 + 1, user_id, '1-URGENT', 'monthly', 50000 + user_id * 1000 FROM (SELECT DISTINCT user_id FROM ledger))""",
        "s AS (SELECT b.*, (SELECT coalesce(sum(amount), 0) FROM active a WHERE nature = 'expense' AND a.user_id = b.user_id AND (b.category_name IS NULL OR a.category_name = b.category_name) AND year(transaction_date) = 2001 AND (period = 'yearly' OR month(transaction_date) = 7)) AS spent FROM budgets b)",
        select="SELECT budget_id, user_id, category_name, period, amount_limit::DOUBLE AS amount_limit, spent::DOUBLE AS spent, greatest(amount_limit - spent, 0)::DOUBLE AS remaining, round(spent::DOUBLE / amount_limit::DOUBLE * 100, 2) AS used_percent FROM s"),
    "d5_tax_totals": with_(LEDGER, TOTALS, select="SELECT user_id, salary_income::DOUBLE AS salary_income, other_income::DOUBLE AS other_income, interest_income::DOUBLE AS interest_income, dividend_income::DOUBLE AS dividend_income, tax_payments::DOUBLE AS tax_payments, investments::DOUBLE AS investments, expenses::DOUBLE AS expenses, (salary_income + other_income + interest_income + dividend_income)::DOUBLE AS total_income FROM totals"),
    "d5_interest_by_account": with_(LEDGER, select="SELECT user_id, bank_name, account_masked, sum(amount)::DOUBLE AS interest, count(*) AS entries FROM active WHERE nature = 'interest_income' AND account_type = 'savings' GROUP BY ALL"),
    "d7_savings_accounts": with_(LEDGER, ROWS, select="SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.bank_name, b.bank_name) AS bank_name, coalesce(a.account_masked, b.account_masked) AS account_masked, coalesce(statements, 0) AS statements, coalesce(entries, 0) AS entries FROM (SELECT user_id, bank_name, account_masked, count(DISTINCT statement_id) AS statements FROM stmt_rows WHERE account_type = 'savings' GROUP BY ALL) a FULL JOIN (SELECT user_id, bank_name, account_masked, count(*) AS entries FROM ledger WHERE account_type = 'savings' GROUP BY ALL) b ON a.user_id = b.user_id AND a.bank_name = b.bank_name AND a.account_masked = b.account_masked"),
    "d8_tax_planning": with_(LEDGER, "told AS (SELECT *, concat_ws(' ', category_name, merchant_normalized, merchant_raw) AS told FROM active WHERE " + FY + ")",
        "users AS (SELECT DISTINCT user_id FROM told)", "sums AS (" + " UNION ALL ".join(f"SELECT u.user_id, {quoted(n)} AS section, {cap} AS cap, coalesce((SELECT sum(amount) FROM told t WHERE t.user_id = u.user_id AND direction = '{'credit' if c else 'debit'}' AND regexp_matches(told, {quoted('(?i)' + p)})), 0) AS amount FROM users u" for n, p, cap, c in rules.SECTION_RULES) + ")",
        select="SELECT user_id, section, amount::DOUBLE AS amount, CASE WHEN cap > 0 THEN greatest(cap - amount, 0)::DOUBLE END AS remaining, CASE WHEN cap > 0 THEN round(least(1.0, amount::DOUBLE / cap) * 100, 2) END AS percent FROM sums"),
    "d12_sender_discovery": """WITH m AS (SELECT lower('Sender' || (user_id % 97) || '@Bank' || (user_id % 7) || '.example') AS sender, 'bank' || (user_id % 7) || '.example' AS domain, value > 50 AS a, event_type IN ('click', 'purchase') AS k FROM events),
        g AS (SELECT sender, domain, count(*) AS messages, count(*) FILTER (a) AS attachments, count(*) FILTER (k) AS keyword_subjects FROM m GROUP BY ALL),
        s AS (SELECT *, round(least(1.0, least(0.4, 0.3 * attachments) + least(0.35, 0.25 * keyword_subjects) + CASE WHEN domain IN ('bank1.example', 'bank3.example') THEN 0.25 ELSE 0 END + least(0.15, ln(messages + 1) / ln(20)))::DOUBLE, 3) AS score FROM g)
        SELECT *, row_number() OVER (ORDER BY score DESC, messages DESC, domain, sender) AS place FROM s QUALIFY place <= 50""",
    "d13_domain_histogram": "SELECT 'bank' || (user_id % 7) || '.example' AS domain, count(*) AS messages FROM events GROUP BY ALL",
    "d14_accounts_tree": with_(LEDGER, ROWS, select="SELECT user_id, bank_name, account_type, account_masked, count(*) AS statements, sum(row_count)::BIGINT AS rows, min(period_start) AS first_start, max(period_end) AS last_end, arg_max(CASE WHEN account_type = 'credit_card' THEN total_due ELSE closing_balance END, (period_end, statement_id))::DOUBLE AS balance FROM statements GROUP BY ALL"),
    "d16_card_totals": with_(LEDGER, ROWS, select="SELECT statement_id, coalesce(sum(amount) FILTER (direction = 'debit'), 0)::DOUBLE AS debits, coalesce(sum(amount) FILTER (direction = 'credit'), 0)::DOUBLE AS credits FROM stmt_rows WHERE account_type = 'credit_card' GROUP BY ALL"),
    "d20_cashflow": with_(LEDGER, select="SELECT user_id, coalesce(sum(amount) FILTER (direction = 'debit'), 0)::DOUBLE AS debits, coalesce(sum(amount) FILTER (direction = 'credit'), 0)::DOUBLE AS credits FROM active GROUP BY ALL"),
    "d21_pending_count": "SELECT user_id, coalesce(sum(TRY_CAST(json_extract_string(props, '$.k') AS INT)), 0)::BIGINT AS pending FROM events GROUP BY ALL",
    "e1_balance_walk": with_("RECURSIVE " + LEDGER, ROWS, "n AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY transaction_date, seq) AS k, count(*) OVER (PARTITION BY statement_id) AS total FROM walked)",
        """w AS (SELECT statement_id, 0::BIGINT AS k, 10000.00::DECIMAL(16,2) AS running, 0::BIGINT AS flagged, NULL::BIGINT AS total FROM (SELECT DISTINCT statement_id FROM statements)
            UNION ALL SELECT n.statement_id, n.k, CASE WHEN off THEN balance_after ELSE moved END::DECIMAL(16,2), flagged + CASE WHEN off OR is_credit IS NULL THEN 1 ELSE 0 END, total FROM (
                SELECT n.*, w.flagged, w.running + CASE WHEN is_credit IS NULL THEN 0 WHEN is_credit THEN amount ELSE -amount END AS moved, coalesce(balance_after IS NOT NULL AND is_credit IS NOT NULL AND abs(w.running + CASE WHEN is_credit THEN amount ELSE -amount END - balance_after) > 1.00, false) AS off
                FROM w JOIN n ON n.statement_id = w.statement_id AND n.k = w.k + 1) n)""",
        select="SELECT w.statement_id, running::DOUBLE AS computed_closing, flagged AS flagged_rows, abs(running - closing_balance) <= 1.00 AS passed FROM w JOIN statements USING (statement_id) WHERE k = total"),
    "e2_simple_walk": with_(LEDGER, ROWS, select="SELECT statement_id, c::DOUBLE AS credits, d::DOUBLE AS debits, n AS rows, abs(opening_balance + c - d - closing_balance)::DOUBLE AS gap, abs(opening_balance + c - d - closing_balance) <= 1 AS passed FROM statements JOIN (SELECT statement_id, coalesce(sum(amount) FILTER (direction = 'credit'), 0) AS c, coalesce(sum(amount) FILTER (direction = 'debit'), 0) AS d, count(*) AS n FROM stmt_rows GROUP BY ALL) USING (statement_id)"),
    "e3_directions": with_(LEDGER, ROWS, "o AS (SELECT *, CASE WHEN user_id % 2 = 1 THEN -seq ELSE seq END AS s FROM walked)",
        "p AS (SELECT *, CASE WHEN first_value(transaction_date) OVER w > last_value(transaction_date) OVER w THEN -s ELSE s END AS turned FROM o WINDOW w AS (PARTITION BY statement_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
        "c AS (SELECT *, balance_after - lag(balance_after) OVER (PARTITION BY statement_id ORDER BY turned) AS change FROM p)",
        select=f"SELECT txn_id, CASE WHEN abs(abs(change) - amount) <= 0.02 THEN CASE WHEN change > 0 THEN 'credit' ELSE 'debit' END WHEN {says('upper(merchant_raw)', rules.CREDIT_NARRATIONS)} THEN 'credit' ELSE 'debit' END AS direction FROM c"),
    "e4_recurring": with_(LEDGER, "r AS (SELECT user_id, bank_name || ' ' || (txn_id % 16) || ' ' || (txn_id % 40 // 8) AS merchant, (1000 + txn_id % 90)::DOUBLE AS a, transaction_date AS d, txn_id, category_name FROM active WHERE nature = 'expense')",
        "g AS (SELECT user_id, merchant, count(*) AS n, avg(a) AS mean, stddev_samp(a) AS sd, max(a) AS hi, min(a) AS lo, min(d) AS f, max(d) AS l, avg(day(d)) AS dy, arg_max(category_name, (d, txn_id)) AS cat, max((d, txn_id)) AS top FROM r GROUP BY ALL)",
        "h AS (SELECT *, (l - f)::DOUBLE / (n - 1) AS gap, round_even(dy, 0)::INT AS ed FROM g WHERE n >= 2 AND greatest(hi - mean, mean - lo) / mean <= 0.20)",
        "i AS (SELECT *, CASE WHEN gap BETWEEN 25 AND 35 THEN 'monthly' WHEN gap BETWEEN 80 AND 100 THEN 'quarterly' WHEN gap BETWEEN 340 AND 390 THEN 'yearly' END AS frequency FROM h)",
        "j AS (SELECT *, (date_trunc('month', l) + CASE frequency WHEN 'monthly' THEN INTERVAL 1 MONTH WHEN 'quarterly' THEN INTERVAL 3 MONTH ELSE INTERVAL 12 MONTH END)::DATE AS m FROM i WHERE frequency IS NOT NULL)",
        select="SELECT user_id, merchant, n AS occurrences, frequency, ed::BIGINT AS expected_day, l AS last_seen, make_date(year(m), month(m), least(ed, day(last_day(m)))) AS next_expected, round(sd / mean, 4) AS amount_variance, (SELECT category_name FROM r WHERE r.user_id = j.user_id AND r.merchant = j.merchant ORDER BY d DESC, r.txn_id DESC LIMIT 1) AS category_name FROM j"),
    "e5_net_worth": with_(LEDGER, ROWS, SNAPS, "days AS (SELECT DISTINCT user_id, as_of_date AS d, max(as_of_date) OVER (PARTITION BY user_id) AS e FROM snaps)",
        "cur AS (SELECT d.user_id, d.d, s.position_key, arg_max(s.balance, (s.as_of_date, s.statement_id)) AS b, any_value(s.entry_kind) AS k FROM days d JOIN snaps s ON s.user_id = d.user_id AND s.as_of_date <= d.d WHERE e - d.d <= 341 GROUP BY ALL)",
        select="SELECT user_id, d AS as_of_date, coalesce(sum(b) FILTER (k = 'asset'), 0)::DOUBLE AS assets, coalesce(sum(b) FILTER (k = 'liability'), 0)::DOUBLE AS liabilities, (coalesce(sum(b) FILTER (k = 'asset'), 0) - coalesce(sum(b) FILTER (k = 'liability'), 0))::DOUBLE AS net FROM cur GROUP BY ALL"),
    "e6_latest_positions": with_(LEDGER, ROWS, SNAPS, select="SELECT user_id, position_key, as_of_date, balance::DOUBLE AS balance, entry_kind FROM snaps QUALIFY row_number() OVER (PARTITION BY user_id, position_key ORDER BY as_of_date DESC, statement_id DESC) = 1"),
    "e7_anomalies": with_(LEDGER, "r AS (SELECT * FROM active WHERE direction = 'debit' AND nature = 'expense' AND transaction_date >= DATE '2001-08-01' - 1500)",
        "b AS (SELECT w.txn_id, count(h.txn_id) AS n, avg(h.amount::DOUBLE) AS mean, stddev_pop(h.amount::DOUBLE) AS sd FROM r w LEFT JOIN r h ON h.user_id = w.user_id AND h.category_name IS NOT DISTINCT FROM w.category_name AND h.amount <> w.amount WHERE w.transaction_date >= DATE '2001-08-01' - 60 GROUP BY ALL)",
        "f AS (SELECT r.*, b.mean, n >= 5 AND sd > 0 AND amount::DOUBLE > mean + 1.6 * sd AS spike, amount >= 5000 AND merchant_normalized IS NOT NULL AND NOT EXISTS (SELECT 1 FROM r p WHERE p.user_id = r.user_id AND upper(p.merchant_normalized) = upper(r.merchant_normalized) AND p.transaction_date < DATE '2001-08-01' - 60) AS fresh FROM r JOIN b USING (txn_id))",
        select="SELECT txn_id, user_id, CASE WHEN spike THEN 'category_spike' ELSE 'new_large_merchant' END AS reason, CASE WHEN spike THEN round(mean, 2) END AS expected_mean FROM f WHERE spike OR fresh"),
    "e9_carried_dates": with_(LEDGER, ROWS, select="SELECT txn_id, last_value(CASE WHEN txn_id % 4 <> 0 THEN transaction_date END IGNORE NULLS) OVER (PARTITION BY statement_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS transaction_date FROM stmt_rows"),
    "e10_superseded": with_(LEDGER, select="SELECT txn_id AS statement_id, row_number() OVER w AS version_no, lead(txn_id) OVER w IS NULL AS is_active FROM ledger WINDOW w AS (PARTITION BY user_id, account_masked ORDER BY transaction_date, txn_id)"),
    "e13_expanded_periods": with_(LEDGER, ROWS, "spans AS (SELECT statement_id, min(transaction_date) AS a, max(transaction_date) AS b FROM stmt_rows GROUP BY statement_id)",
        select="SELECT statement_id, least(period_start + 9, a) AS period_start, greatest(period_end - 9, b) AS period_end FROM statements JOIN spans USING (statement_id)"),
    "e14_recent_history": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id",
    "e15_latest_per_key": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "b1_filtered": with_(LEDGER, select="SELECT txn_id FROM ledger WHERE transaction_date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31' AND bank_name = 'BUILDING' AND direction = 'debit' AND amount BETWEEN 1000 AND 200000 AND (merchant_raw ILIKE '%upi%' OR merchant_normalized ILIKE '%upi%' OR notes ILIKE '%upi%')"),
    "b3_month_of_user": with_(LEDGER, select="SELECT txn_id, nature FROM ledger WHERE user_id = 7 AND transaction_date >= DATE '1999-01-01' AND transaction_date < DATE '2000-01-01'"),
    "b11_labels": with_(LEDGER, select="SELECT DISTINCT bank_name, account_type, CASE WHEN length(bank_name) <= 4 THEN bank_name ELSE bank_name[1] || lower(bank_name[2:]) END || ' ' || CASE account_type WHEN 'credit_card' THEN 'CC' ELSE 'Saving' END AS label FROM ledger"),
    "f1_page": with_(LEDGER, select="SELECT txn_id, transaction_date FROM ledger ORDER BY transaction_date DESC, txn_id LIMIT 20 OFFSET 40"),
    "f5_large_cash": with_(LEDGER, select="SELECT user_id, txn_id, amount::DOUBLE AS amount, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, txn_id) AS place FROM active WHERE nature = 'expense' AND regexp_matches(merchant_raw, 'ATM|CASH') AND amount >= 10000 QUALIFY place <= 20"),
    "h13_search": with_(LEDGER, "f AS (SELECT *, lower(coalesce(merchant_normalized, '')) AS a, lower(merchant_raw) AS b, lower(coalesce(notes, '')) AS c, lower(bank_name) AS d FROM active)",
        "h AS (SELECT *, " + " + ".join(f"3.0 * contains(a, '{w}')::INT + 2.0 * contains(b, '{w}')::INT + contains(c, '{w}')::INT + contains(d, '{w}')::INT + 0.0" for w in ("upi", "swiggy", "order")) + " + 5.0 * (contains(a, 'upi swiggy order') OR contains(b, 'upi swiggy order') OR contains(c, 'upi swiggy order') OR contains(d, 'upi swiggy order'))::INT AS s, regexp_matches(lower(coalesce(category_name, '')), 'upi|swiggy|order') AS in_category FROM f)",
        "r AS (SELECT * FROM h WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY transaction_date DESC, txn_id) <= 500)",
        select="SELECT txn_id, user_id, transaction_date, (s + 1.5 * in_category::INT)::DOUBLE AS score, row_number() OVER (PARTITION BY user_id ORDER BY s + 1.5 * in_category::INT DESC, transaction_date DESC, txn_id) AS place FROM r QUALIFY place <= 25"),
    "g1_fingerprints": with_(LEDGER, "p AS (SELECT *, substr(trim(regexp_replace(regexp_replace(upper(merchant_raw), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 1, 30) AS n FROM ledger)",
        select="SELECT txn_id, sha256(user_id || '|' || upper(account_masked) || '|' || transaction_date::VARCHAR || '|' || (amount * 100)::BIGINT || '|' || n) AS fingerprint, sha256(account_masked || '|' || transaction_date::VARCHAR || '|' || (amount * 100)::BIGINT || '|' || substr(lower(merchant_raw), 1, 40) || '|' || CASE direction WHEN 'credit' THEN 'cr' ELSE 'dr' END) AS dedup_key FROM p"),
    "g2_statement_fingerprints": with_(LEDGER, ROWS, select="SELECT statement_id, sha256(user_id || '|' || upper(bank_name) || '|' || upper(account_masked) || '|' || period_start::VARCHAR || '|' || period_end::VARCHAR || '|1000000') AS fingerprint FROM statements"),
    "g4_batch_dedup": with_(LEDGER, "k AS (SELECT *, user_id || '|' || strftime(transaction_date, '%Y-%m') || '|' || (txn_id % 5) AS key FROM ledger)",
        select="SELECT txn_id FROM k WHERE key NOT IN (SELECT user_id || '|' || strftime(transaction_date + 400, '%Y-%m') || '|' || (txn_id % 5) FROM ledger) QUALIFY row_number() OVER (PARTITION BY key ORDER BY transaction_date, txn_id) = 1"),
    "g7_insert_counts": with_(LEDGER, "n AS (SELECT * FROM ledger WHERE year(transaction_date) >= 1998)", "o AS (SELECT * FROM ledger WHERE year(transaction_date) < 1998 AND user_id % 2 = 0)",
        select="SELECT a AS rows, b AS inserted, a - b AS duplicates FROM (SELECT (SELECT count(*) FROM n) AS a, (SELECT count(*) FROM (SELECT DISTINCT user_id, category_name FROM n) x WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = x.user_id AND o.category_name IS NOT DISTINCT FROM x.category_name)) AS b)"),
    "g11_orphans": "SELECT o_orderkey AS txn_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "i1_nature_counts": with_(LEDGER, select="SELECT direction, account_type, nature, count(*) AS n FROM ledger GROUP BY ALL"),
    "i3_merchants": with_(LEDGER, select="SELECT DISTINCT merchant_raw, CASE WHEN regexp_matches(merchant_raw, '(?i)netflix|rent') THEN 'Home' WHEN contains(upper(merchant_raw), 'SWIGGY') THEN 'Swiggy' WHEN contains(upper(merchant_raw), 'MUTUAL FUND') THEN 'Fund' ELSE 'UPI payment' END AS merchant, CASE WHEN regexp_matches(merchant_raw, '(?i)netflix|rent') THEN 'Home' WHEN contains(upper(merchant_raw), 'SWIGGY') THEN 'Food Delivery' WHEN contains(upper(merchant_raw), 'MUTUAL FUND') THEN 'Investment' ELSE 'Transfer' END AS category FROM ledger WHERE regexp_matches(merchant_raw, '(?i)netflix|rent|swiggy|mutual fund|upi')"),
    "i4_categories": with_(LEDGER, select="SELECT txn_id, CASE " + " ".join(f"WHEN {says(RAW, w)} THEN {quoted(c)}" for w, c in rules.CATEGORY_RULES) + " END AS guess FROM ledger"),
    "i7_recurring_buckets": with_(LEDGER, select="SELECT CASE " + " ".join(f"WHEN regexp_matches(concat_ws(' ', merchant_raw, category_name), {quoted('(?i)' + p)}) THEN {quoted(n)}" for n, p in rules.RECURRING_RULES) + " ELSE 'other' END AS bucket, count(*) AS n FROM ledger GROUP BY ALL"),
    "c1_category_join": with_(LEDGER, select="SELECT coalesce(category_name <> '5-LOW', false) AS known, count(*) AS n FROM ledger GROUP BY ALL"),
    "c10_duplicates": with_(LEDGER, SMS, "k AS (SELECT 'l' AS side, * FROM ledger UNION ALL SELECT 's', * FROM sms)",
        "p AS (SELECT *, user_id || '|' || upper(account_masked) || '|' || transaction_date || '|' || amount || '|' || substr(trim(regexp_replace(regexp_replace(upper(merchant_raw), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), 1, 30) AS fp, CASE WHEN txn_id % 13 = 0 THEN 'REF' || (txn_id % 1000000000) END AS ref FROM k)",
        """m AS (SELECT s.txn_id, l.txn_id AS match_id, CASE WHEN s.fp = l.fp THEN 0 WHEN s.ref = l.ref AND s.direction = l.direction AND s.account_masked = l.account_masked THEN 1 WHEN s.amount = l.amount AND s.direction = l.direction AND abs(s.transaction_date - l.transaction_date) <= 3 THEN 3 END AS tier, abs(s.transaction_date - l.transaction_date) AS gap
            FROM p s JOIN p l ON s.user_id = l.user_id AND l.side = 'l' AND s.side = 's')""",
        select="SELECT txn_id, match_id, CASE tier WHEN 0 THEN 'fingerprint_exact' WHEN 1 THEN 'exact_ref' ELSE 'fuzzy' END AS method, CASE tier WHEN 0 THEN 0.99 WHEN 1 THEN 1.0 ELSE round(greatest(0.6, 0.8 - gap * 0.2 / 3)::DOUBLE, 4) END::DOUBLE AS confidence FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY tier, CASE WHEN tier = 3 THEN gap ELSE 0 END, match_id) = 1"),
    "c13_sms_statement_match": with_(LEDGER, SMS, select="SELECT s.txn_id AS sms_id, l.txn_id, abs(l.transaction_date - s.transaction_date)::BIGINT AS day_gap, l.transaction_date AS matched_date FROM sms s JOIN ledger l ON s.user_id = l.user_id AND s.account_masked IS NOT DISTINCT FROM l.account_masked AND s.direction = l.direction AND abs(s.amount - l.amount) <= 1.00 AND abs(l.transaction_date - s.transaction_date) <= 3 QUALIFY row_number() OVER (PARTITION BY s.txn_id ORDER BY day_gap, l.transaction_date, l.txn_id) = 1"),
    "j9_bills": with_(LEDGER, ROWS, select="SELECT user_id, bank_name, account_masked, due_date, min(statement_id) AS statement_id, arg_min(total_due, statement_id)::DOUBLE AS total_due FROM statements WHERE total_due IS NOT NULL GROUP BY ALL"),
    "j6_audit": with_(LEDGER, select="SELECT * FROM (SELECT txn_id, unnest(['nature', 'category_name', 'notes']) AS field, unnest([nature, category_name, notes]) AS old_value, unnest(['expense', '5-LOW', 'set by rule']) AS new_value FROM ledger WHERE txn_id % 20 = 0) WHERE old_value IS DISTINCT FROM new_value"),
    "l13_itr_form": with_(TAXPAYERS, "p AS (SELECT *, user_id % 5 = 0 AS biz, user_id % 10 = 0 AS pre, user_id % 7 = 0 AS cg, user_id % 17 = 0 AS fa, user_id % 19 <> 0 AS res, user_id % 6 * 1500 AS farm FROM taxpayers)",
        "b AS (SELECT *, concat_ws(',', CASE WHEN NOT res THEN 'non_resident' END, CASE WHEN gross_salary > 5000000 THEN 'income_over_50_lakh' END, CASE WHEN cg THEN 'capital_gains' END, CASE WHEN fa THEN 'foreign_assets' END, CASE WHEN farm > 5000 THEN 'agricultural_income' END) AS blockers FROM p)",
        select="SELECT user_id, CASE WHEN biz AND pre AND gross_salary <= 5000000 AND NOT cg AND NOT fa AND res THEN 'ITR-4' WHEN biz THEN 'ITR-3' WHEN blockers = '' THEN 'ITR-1' ELSE 'ITR-2' END AS form, blockers FROM b"),
    "m1_form16": with_(LEDGER, TOTALS, BUCKETS, PORTAL, select="SELECT coalesce(p.user_id, b.user_id) AS user_id, gross_salary::DOUBLE AS portal_amount, amount::DOUBLE AS ledger_amount, CASE WHEN gross_salary IS NULL THEN 'missing_in_portal' WHEN amount IS NULL THEN 'missing_in_ledger' WHEN abs(gross_salary - amount) <= 100 THEN 'matched' ELSE 'amount_mismatch' END AS kind FROM (SELECT * FROM portal WHERE gross_salary IS NOT NULL) p FULL JOIN (SELECT * FROM buckets WHERE bucket = 'salary') b ON p.user_id = b.user_id"),
    "m3_self_paid": with_(LEDGER, TOTALS, BUCKETS, PORTAL, select="SELECT coalesce(p.user_id, b.user_id) AS user_id, self_paid_tax::DOUBLE AS portal_amount, amount::DOUBLE AS ledger_amount, CASE WHEN self_paid_tax IS NULL THEN 'missing_in_portal' WHEN amount IS NULL THEN 'missing_in_ledger' WHEN abs(self_paid_tax - amount) <= 1 THEN 'matched' ELSE 'amount_mismatch' END AS kind FROM (SELECT * FROM portal WHERE self_paid_tax IS NOT NULL) p FULL JOIN (SELECT * FROM buckets WHERE bucket = 'tax_paid') b ON p.user_id = b.user_id"),
    "m4_ais_buckets": with_(LEDGER, TOTALS, BUCKETS, PORTAL, "l AS (SELECT * FROM (SELECT user_id, unnest(['salary', 'interest', 'dividend']) AS bucket, unnest([gross_salary, interest_income, dividend_income]) AS p FROM portal) WHERE p IS NOT NULL)",
        select="SELECT coalesce(l.user_id, b.user_id) AS user_id, coalesce(l.bucket, b.bucket) AS bucket, p::DOUBLE AS portal_amount, amount::DOUBLE AS ledger_amount, CASE WHEN p IS NULL THEN 'missing_in_portal' WHEN amount IS NULL THEN 'missing_in_ledger' WHEN abs(p - amount) <= 100 THEN 'matched' ELSE 'amount_mismatch' END AS kind FROM l FULL JOIN (SELECT * FROM buckets WHERE bucket <> 'tax_paid') b ON l.user_id = b.user_id AND l.bucket = b.bucket UNION ALL SELECT user_id, 'securities', securities_sold::DOUBLE, NULL, 'flagged' FROM portal WHERE securities_sold > 0"),
    "m5_line_sums": with_(LEDGER, INCOME, select="SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.fy, b.fy) AS fy, coalesce(a.bucket, b.bucket) AS bucket, a.s::DOUBLE AS portal_amount, b.s::DOUBLE AS ledger_amount, CASE WHEN a.s IS NULL THEN 'missing_in_portal' WHEN b.s IS NULL THEN 'missing_in_ledger' WHEN abs(a.s - b.s) <= 100 OR abs(a.s - b.s)::DOUBLE / greatest(a.s, b.s)::DOUBLE <= 0.05 THEN 'matched' ELSE 'amount_mismatch' END AS kind FROM (SELECT user_id, fy, bucket, sum(amount) AS s FROM lines GROUP BY ALL) a FULL JOIN (SELECT user_id, fy, bucket, sum(amount) AS s FROM income GROUP BY ALL) b ON a.user_id = b.user_id AND a.fy = b.fy AND a.bucket = b.bucket"),
    "m10_action_items": with_(LEDGER, TOTALS, FACTS, "x AS (SELECT user_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {quoted(s + ':' + t)} END" for c, s, t in (
            ("tax_form = 0", "warning", "Missing Tax Forms"), ("interest_income > 0 AND interest_certificate = 0", "warning", "Interest Income Without Certificate"), ("dividend_income > 0 AND dividend_report = 0", "warning", "Dividend Income Without Report"),
            ("tax_payments > 0 AND tax_challan = 0", "warning", "Tax Payments Without Challan"), ("other_income >= 50000", "info", "Review Other Income"), ("large_cash > 0", "warning", "High-Value Cash Transactions"), ("savings_accounts = 0", "warning", "No Savings Statements Linked"),
            ("interest_income > 0 AND abs(interest_income - documented_interest) >= 5000", "warning", "Interest Income Mismatch"), ("tax_payments > 0 AND abs(tax_payments - documented_tax) >= 1000", "warning", "Tax Payment Documentation Gap"), ("unresolved_documents > 0", "info", "Unresolved Statement Parsers"))) + "], lambda i: i IS NOT NULL)) AS i FROM facts)",
        select="SELECT user_id, split_part(i, ':', 1) AS severity, split_part(i, ':', 2) AS title FROM x UNION ALL SELECT user_id, 'ok', 'No Immediate Tax Flags' FROM facts WHERE user_id NOT IN (SELECT user_id FROM x)"),
    "m12_checklist": with_(LEDGER, INCOME, TAX_FACTS, select=" UNION ALL ".join(f"SELECT user_id, {quoted(n)} AS kind, {v} AS severity, {e} AS evidence FROM tax_facts WHERE {c}" for c, n, v, e in (
        ("NOT has_ais", "MISSING_AIS", "'block_filing'", "NULL"), ("NOT has_26as", "MISSING_26AS", "'block_filing'", "NULL"), ("NOT has_form16", "MISSING_FORM_16", "CASE WHEN ais_salary THEN 'block_filing' ELSE 'warning' END", "NULL"),
        ("form16a_sections > 0", "MISSING_FORM_16A", "'warning'", "form16a_sections"), ("ais_securities", "MISSING_CG_DOC", "'warning'", "NULL"), ("ais_interest_lines > 0", "MISSING_INTEREST_CERT", "'info'", "ais_interest_lines"),
        ("coverage_rows = 0", "MISSING_BANK_STATEMENTS", "'warning'", "NULL"), ("coverage_rows > 0 AND ledger_rows < 10", "LOW_LEDGER_COVERAGE", "'warning'", "NULL")))),
    "m11_cross_verify": with_(LEDGER, TOTALS, "a AS (SELECT user_id, salary_income + other_income + interest_income + dividend_income AS ti, salary_income AS si, interest_income AS ii, 0 AS td, tax_payments AS ap FROM totals)", "p AS (SELECT user_id, ti, si + user_id % 3 * 300 AS si, ii, td, ap + user_id % 2 AS ap FROM a WHERE user_id % 4 <> 0)",
        "u AS (" + " UNION ALL ".join(f"SELECT a.user_id, {quoted(n)} AS \"check\", a.{c} AS x, coalesce(p.{c}, 0) AS y, {t} AS tolerance FROM a LEFT JOIN p USING (user_id)" for n, c, t in (("total_income", "ti", 1000), ("salary_income", "si", 500), ("interest_income", "ii", 100), ("tds_deducted", "td", 100), ("advance_tax_paid", "ap", 0))) + ")",
        select="SELECT user_id, \"check\", x::DOUBLE AS app_amount, y::DOUBLE AS portal_amount, tolerance::BIGINT AS tolerance, CASE WHEN x = 0 AND y = 0 THEN 'unverified' WHEN abs(x - y) <= tolerance THEN 'match' ELSE 'mismatch' END AS status FROM u"),
    "e12_chunks": "SELECT doc_id, k AS chunk_no, sha256(substr(text, (k * 1560 + 1)::BIGINT, 1800)) AS chunk_sha256 FROM (SELECT doc_id, text, unnest(range(1 + greatest(length(text) - 241, 0) // 1560)) AS k FROM documents WHERE length(text) > 0)",
    "o2_claim_order": """WITH j AS (SELECT event_id, user_id, event_type = 'click' AS running, event_id % 3 AS p, ts FROM events),
        q AS (SELECT user_id, arg_min(event_id, (-p, ts, event_id)) AS job_id, min(ts) AS oldest FROM j WHERE NOT running GROUP BY ALL), r AS (SELECT user_id, count(*) AS n FROM j WHERE running GROUP BY ALL)
        SELECT q.user_id, job_id, row_number() OVER (ORDER BY coalesce(n, 0), oldest, q.user_id) AS place FROM q LEFT JOIN r USING (user_id)""",
    "o3_retries": "SELECT event_id AS job_id, CASE WHEN event_id % 5 < 3 THEN 'queued' ELSE 'dlq' END AS next_status, CASE WHEN event_id % 5 < 3 THEN least(300, 2 ** greatest(event_id % 5, 1))::BIGINT END AS wait_seconds FROM events",
    "o6_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4)), 2)::DOUBLE AS value FROM events GROUP BY ALL",
}

KEYWORD_SKIP = listed(rules.STATEMENT_STOPWORDS)
FLAT = r"trim(regexp_replace(lower(text), '[\s_\-/\\]+', ' ', 'g'))"


def slab_sum(income: str, brackets) -> str:
    """Tax on slabs, each part rounded half up to the paisa; amounts have two places."""
    parts, lower = [], 0
    for upper, percent in brackets:
        top = f"({income})" if upper is None else f"least({income}, {upper})"
        parts.append(f"floor((greatest({top} - {lower}, 0)::DECIMAL(20,2) * {percent * 100} + 50) / 100)")
        lower = upper
    return "((" + " + ".join(parts) + ") / 100)"


ORACLE_SQL |= {
    "h23_text_quality": f"""SELECT doc_id, length(trim(text)) < 60 OR length(regexp_replace(trim(text), '[^\\p{{L}}]', '', 'g'))::DOUBLE / greatest(length(trim(text)), 1) < 0.15 AS low_signal,
        len(list_distinct(list_filter(regexp_extract_all({FLAT}, '[a-z0-9]{{3,}}'), lambda w: NOT list_contains({KEYWORD_SKIP}, w) AND NOT regexp_full_match(w, '[0-9]+'))[1:80]))::BIGINT AS keywords FROM documents""",
    "h24_difficulty": """WITH d AS (SELECT doc_id, length(text)::DOUBLE AS n, length(text) - length(replace(text, chr(10), '')) + 1 AS l, length(regexp_replace(text, '[^|~`\f]', '', 'g'))::DOUBLE AS z FROM documents),
        s AS (SELECT doc_id, 0.75 + least(3.0, n / 14000) + least(2.0, l / 1200.0) + least(1.5, z / greatest(n, 1) * 100 / 3) AS x FROM d)
        SELECT doc_id, round(x::DOUBLE, 4) AS score, CASE WHEN x < 3.5 THEN 'low' WHEN x < 6.5 THEN 'medium' ELSE 'high' END AS band FROM s""",
    "i11_card_integrity": with_(LEDGER, ROWS, "x AS (SELECT statement_id, total_due::DOUBLE AS due, 10000.0::DOUBLE AS prev, closing_balance::DOUBLE AS closing, row_count, (SELECT coalesce(sum(amount) FILTER (direction = 'debit'), 0) - coalesce(sum(amount) FILTER (direction = 'credit'), 0) FROM stmt_rows r WHERE r.statement_id = s.statement_id AND r.account_type = 'credit_card')::DOUBLE AS net FROM statements s WHERE account_type = 'credit_card')",
        select="SELECT statement_id, net AS net_activity, round(abs(due - net), 2) AS due_gap, round(abs(closing - round(prev + net, 2)), 2) AS closing_gap, CASE WHEN abs(due - (prev + net)) <= greatest(500, abs(due) * 0.10) OR abs(due - net) <= greatest(500, abs(due) * 0.10) OR abs(closing - (prev + net)) <= greatest(250, abs(closing) * 0.02) THEN 'ok' ELSE 'review' END AS status FROM x"),
    "c16_reimported": with_(LEDGER, "o AS (SELECT txn_id, 'f' || (txn_id % 900) AS fh, user_id || '|' || strftime(transaction_date, '%Y-%m') AS fp, transaction_date || '|' || (amount * 100)::BIGINT || '|' || substr(upper(merchant_raw), 1, 30) AS sig FROM (SELECT * REPLACE (trim(regexp_replace(regexp_replace(upper(merchant_raw), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS merchant_raw) FROM ledger))",
        "n AS (SELECT txn_id, CASE WHEN txn_id % 2 = 0 THEN fh ELSE 'new' END AS fh, CASE WHEN txn_id % 9 = 0 THEN fp ELSE 'other' END AS fp, sig FROM o WHERE txn_id % 3 = 0)",
        select="SELECT txn_id FROM n WHERE EXISTS (SELECT 1 FROM o WHERE o.fh = n.fh AND o.sig = n.sig) OR EXISTS (SELECT 1 FROM o WHERE o.fp = n.fp AND o.sig = n.sig)"),
    "j5_splits": with_(LEDGER, select="SELECT gone OR is_excluded AS is_excluded, false AS is_part, count(*) AS n, sum(amount)::DOUBLE AS amount FROM (SELECT *, txn_id % 50 = 0 AND txn_id % 100 <> 0 AND NOT is_excluded AS gone FROM ledger) GROUP BY ALL UNION ALL SELECT false, true, 2 * count(*), sum(amount)::DOUBLE FROM ledger WHERE txn_id % 50 = 0 AND txn_id % 100 <> 0 AND NOT is_excluded HAVING count(*) > 0"),
    "l9_capital_gains": """WITH l AS (SELECT o_custkey % 200 AS user_id, DATE '2024-04-01' + (o_orderkey % 365)::INT < DATE '2024-07-23' AS pre, o_orderkey % 2 = 0 AS short, o_totalprice::DECIMAL(14,2) AS a FROM orders),
        s AS (SELECT user_id, coalesce(sum(a) FILTER (short AND pre), 0) AS stcg_pre, coalesce(sum(a) FILTER (short AND NOT pre), 0) AS stcg_post, coalesce(sum(a) FILTER (NOT short AND pre), 0) AS ltcg_pre, coalesce(sum(a) FILTER (NOT short AND NOT pre), 0) AS ltcg_post FROM l GROUP BY ALL),
        t AS (SELECT *, floor(stcg_pre * 15 + 0.5) / 100 + floor(stcg_post * 20 + 0.5) / 100 AS stcg_tax, floor(greatest(ltcg_pre - 100000, 0) * 10 + 0.5) / 100 + floor(greatest(ltcg_post - 125000, 0) * 12.5 + 0.5) / 100 AS ltcg_tax FROM s)
        SELECT user_id, stcg_pre::DOUBLE AS stcg_pre, stcg_post::DOUBLE AS stcg_post, ltcg_pre::DOUBLE AS ltcg_pre, ltcg_post::DOUBLE AS ltcg_post, round(stcg_tax::DOUBLE, 2) AS stcg_tax, round(ltcg_tax::DOUBLE, 2) AS ltcg_tax, (least(ltcg_pre, 100000) + least(ltcg_post, 125000))::DOUBLE AS exemption_used, round((stcg_tax + ltcg_tax)::DOUBLE, 2) AS total_tax FROM t""",
    "l11_utilisation": with_(TAXPAYERS, select=" UNION ALL ".join(
        f"SELECT user_id, {quoted(n)} AS section, {cap}::DOUBLE AS cap, {c}::DOUBLE AS claimed, greatest({cap} - {c}, 0)::DOUBLE AS remaining FROM taxpayers" for n, c, cap in (
            ("80C/80CCC/80CCD(1)", "d80c", "150000"), ("80CCD(1B)", "d1b", "50000"), ("80D (self)", "dself", "(CASE WHEN is_senior THEN 50000 ELSE 25000 END)"), ("80D (parents)", "dparents", "50000"),
            ("80TTA/80TTB", "dtta", "(CASE WHEN is_senior THEN 50000 ELSE 10000 END)"), ("24(b) self-occupied", "house_self", "200000"))) + " UNION ALL SELECT user_id, '80E', NULL, d80e::DOUBLE, NULL FROM taxpayers"),
    "m8_reports": with_(LEDGER, TOTALS, BUCKETS, PORTAL, "u AS (" + " UNION ALL ".join(f"SELECT coalesce(p.user_id, b.user_id) AS user_id, {quoted(src)} AS source, p.v, b.amount AS l, {tol} AS tol FROM (SELECT user_id, {col} AS v FROM portal WHERE {col} IS NOT NULL) p FULL JOIN (SELECT * FROM buckets WHERE bucket = {quoted(bucket)}) b ON p.user_id = b.user_id" for src, col, bucket, tol in (("form16", "gross_salary", "salary", 100), ("self_paid", "self_paid_tax", "tax_paid", 1))) + ")",
        select="SELECT user_id, source, count(*) FILTER (v IS NOT NULL AND l IS NOT NULL AND abs(v - l) <= tol) AS matched, count(*) FILTER (l IS NULL) AS missing_in_ledger, count(*) FILTER (v IS NULL) AS missing_in_portal, count(*) FILTER (v IS NOT NULL AND l IS NOT NULL AND abs(v - l) > tol) AS amount_mismatch, coalesce(sum(v), 0)::DOUBLE AS portal_total, coalesce(sum(l), 0)::DOUBLE AS ledger_total FROM u GROUP BY ALL"),
    "l7_compare_regimes": with_(TAXPAYERS,
        "g AS (SELECT *, gross_salary + interest_income + dividend_income + rental + other_income AS gti, floor(stcg * 20 + 0.5) / 100 + floor(greatest(ltcg - 125000, 0) * 12.5 + 0.5) / 100 AS special FROM taxpayers)",
        "t AS (SELECT *, greatest(gti - 50000 - least(house_self, 200000) - house_let - (least(d80c, 150000) + least(d1b, 50000) + least(dself, CASE WHEN is_senior THEN 50000 ELSE 25000 END) + least(dparents, 50000) + d80e + d80g + least(dtta, CASE WHEN is_senior THEN 50000 ELSE 10000 END) + d2), 0) AS old_taxable, greatest(gti - 75000 - least(house_let, 200000) - d2, 0) AS new_taxable FROM g)",
        "s AS (SELECT *, CASE WHEN is_super THEN " + slab_sum("old_taxable", rules.OLD_SLABS["super_senior"]) + " WHEN is_senior THEN " + slab_sum("old_taxable", rules.OLD_SLABS["senior"]) + " ELSE " + slab_sum("old_taxable", rules.OLD_SLABS["below_60"]) + " END AS old_slab_tax, " + slab_sum("new_taxable", rules.NEW_SLABS["2024-25"]) + " AS new_slab_tax FROM t)",
        "r AS (SELECT *, CASE WHEN old_taxable <= 500000 THEN least(old_slab_tax, 12500) ELSE 0 END AS old_rebate, CASE WHEN new_taxable <= 700000 THEN least(new_slab_tax, 25000) ELSE 0 END AS new_rebate FROM s)",
        "x AS (SELECT *, greatest(old_slab_tax + special - old_rebate, 0) AS old_tax, greatest(new_slab_tax + special - new_rebate, 0) AS new_tax, CASE WHEN gti > 50000000 THEN 37 WHEN gti > 20000000 THEN 25 WHEN gti > 10000000 THEN 15 WHEN gti > 5000000 THEN 10 ELSE 0 END AS op, CASE WHEN gti > 20000000 THEN 25 WHEN gti > 10000000 THEN 15 WHEN gti > 5000000 THEN 10 ELSE 0 END AS np, CASE WHEN gti > 50000000 THEN 50000000 WHEN gti > 20000000 THEN 20000000 WHEN gti > 10000000 THEN 10000000 ELSE 5000000 END AS ot, CASE WHEN gti > 20000000 THEN 20000000 WHEN gti > 10000000 THEN 10000000 ELSE 5000000 END AS nt FROM r)",
        "y AS (SELECT *, floor(old_tax::DECIMAL(20,2) * op + 0.5) / 100 AS ofull, floor(new_tax::DECIMAL(20,2) * np + 0.5) / 100 AS nfull, CASE WHEN is_super THEN " + slab_sum("ot", rules.OLD_SLABS["super_senior"]) + " WHEN is_senior THEN " + slab_sum("ot", rules.OLD_SLABS["senior"]) + " ELSE " + slab_sum("ot", rules.OLD_SLABS["below_60"]) + " END AS oat, " + slab_sum("nt", rules.NEW_SLABS["2024-25"]) + " AS nat FROM x)",
        "z AS (SELECT *, ofull - CASE WHEN ofull > 0 THEN least(greatest(old_tax + ofull - oat - (gti - ot), 0), ofull) ELSE 0 END AS old_surcharge, nfull - CASE WHEN nfull > 0 THEN least(greatest(new_tax + nfull - nat - (gti - nt), 0), nfull) ELSE 0 END AS new_surcharge FROM y)",
        "c AS (SELECT *, floor((old_tax + old_surcharge) * 4 + 0.5) / 100 AS old_cess, floor((new_tax + new_surcharge) * 4 + 0.5) / 100 AS new_cess FROM z)",
        "f AS (SELECT *, old_tax + old_surcharge + old_cess AS old_total, new_tax + new_surcharge + new_cess AS new_total FROM c)",
        select="SELECT user_id, " + ", ".join(f"round({c}::DOUBLE, 2) AS {c}" for c in ("old_taxable", "old_slab_tax", "old_rebate", "old_surcharge", "old_cess", "old_total", "new_taxable", "new_slab_tax", "new_rebate", "new_surcharge", "new_total")) + ", round((old_total - new_total)::DOUBLE, 2) AS delta, CASE WHEN round((old_total - new_total)::DOUBLE, 2) > 0 THEN 'new' WHEN round((old_total - new_total)::DOUBLE, 2) < 0 THEN 'old' ELSE 'neutral' END AS recommendation FROM f"),
}


def any_of(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {quoted(p)})" for p in patterns) + ")"


MESSAGES = """m AS (SELECT txn_id AS sms_id, ['AD-HDFCBK', 'VM-ICICIT-S', 'BZ-AXISBK', '+919876543210', 'XX-UNKNWN'][(txn_id % 5)::INT + 1] AS address,
    CASE txn_id % 6 WHEN 0 THEN 'Rs.' || a || ' debited from a/c XX1234 on UPI Ref No 123456789012 to shop@okbank. Avl bal Rs.' || a WHEN 1 THEN 'INR ' || a || ' credited to account XX' || lpad((txn_id % 10000)::VARCHAR, 4, '0')
        WHEN 2 THEN '482913 is your OTP. Do not share your OTP with anyone' WHEN 3 THEN 'Exclusive offer: cashback up to Rs.500, apply now' WHEN 4 THEN 'Your KYC expired, click http://bit.ly/x to verify' ELSE 'Balance in your account is Rs.' || a END AS body
    FROM (SELECT txn_id, format('{:,.2f}', amount::DOUBLE) AS a FROM ledger))"""
SPAM = (
    "least(100, CASE WHEN address IN ('+919876543210', 'XX-UNKNWN') THEN 40 ELSE 0 END + CASE WHEN address = '+919876543210' THEN 40 ELSE 0 END"
    " + CASE WHEN contains(body, 'http://bit.ly') THEN 25 ELSE 0 END + least(20, " + " + ".join(f"10 * regexp_matches(body, {quoted(p)})::INT" for p in rules.SPAM_URGENT) + ")"
    f" + 25 * {any_of('body', rules.SPAM_SENSITIVE)}::INT + 40 * {any_of('body', rules.SPAM_TEMPLATE)}::INT + 10 * (NOT {any_of('body', rules.SMS_AMOUNT)})::INT)"
)
ORACLE_SQL |= {
    "i18_sms_classes": with_(LEDGER, MESSAGES, f"s AS (SELECT *, {SPAM} AS score, {any_of('body', rules.SMS_AMOUNT)} AS amount, regexp_matches(body, {quoted(rules.SMS_HAS_ACCOUNT)}) AS account FROM m)",
        select=f"SELECT sms_id, score::BIGINT AS spam_score, CASE WHEN score >= 50 THEN 'spam' WHEN {any_of('body', rules.SMS_OTP)} THEN 'otp' WHEN {any_of('body', rules.SMS_PROMO)} AND NOT account THEN 'promo' WHEN {any_of('body', rules.SMS_DEBIT)} AND amount AND account THEN 'transaction_debit' WHEN {any_of('body', rules.SMS_CREDIT)} AND amount AND account THEN 'transaction_credit' WHEN amount AND regexp_matches(body, '(?i)balance') THEN 'balance_info' ELSE 'unknown' END AS sms_class FROM s"),
    "a10_export": with_(LEDGER, select="SELECT transaction_date::VARCHAR AS transaction_date, merchant_raw AS description, coalesce(merchant_normalized, '') AS merchant, coalesce(category_name, '') AS category, format('{:.2f}', amount::DOUBLE) AS amount, direction, nature, bank_name AS bank, account_masked AS account FROM active"),
    "j10_snapshots": with_(LEDGER, ROWS, SNAPS, select="SELECT statement_id, user_id, position_key, as_of_date::DATE::VARCHAR AS as_of_date, balance::DOUBLE AS balance, entry_kind FROM snaps"),
    "i10_gates": with_(LEDGER, ROWS, "g AS (SELECT *, CASE WHEN user_id % 3 <> 0 THEN row_count * (1 + user_id % 4) + 4 END AS e FROM statements)",
        select="SELECT statement_id, round(row_count::DOUBLE / e, 4) AS yield_rate, CASE WHEN user_id % 13 = 0 OR coalesce(e >= 5 AND row_count::DOUBLE / e < 0.55, false) OR (user_id % 5 <> 0 AND user_id % 7 = 0) OR user_id % 11 = 0 THEN 'review_required' ELSE 'parsed' END AS parse_status FROM g"),
    "d10_health": "SELECT event_type, round(count(*) FILTER (value > 20)::DOUBLE / count(*), 4) AS success_rate, round(count(*) FILTER (value > 50)::DOUBLE / nullif(count(*) FILTER (value > 10 AND event_type <> 'click'), 0), 4) AS yield_rate FROM events GROUP BY ALL",
    "d11_parser_support_queue": """WITH f AS (SELECT event_type AS bank_name, (user_id % 2)::VARCHAR AS account_type, 'r' || (event_id % 3) AS reason, 'f' || (event_id % 11) AS file_name, event_id FROM events),
        g AS (SELECT bank_name, account_type, reason, file_name, count(*) AS n, max(event_id) AS seen FROM f GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY bank_name, account_type, reason ORDER BY seen DESC, file_name) AS k FROM g)
        SELECT bank_name, account_type, reason, sum(n)::BIGINT AS failures, string_agg(file_name, ',' ORDER BY k) FILTER (k <= 5) AS files, max(seen) AS last_seen, 'm' || max(seen) AS message FROM h GROUP BY ALL""",
    "m2_tds": with_(LEDGER, TOTALS, "p AS (SELECT user_id, round(interest_income * 10 / 100, 2)::DECIMAL(24,2) AS v FROM totals WHERE user_id % 4 <> 0)", "d AS (SELECT user_id, round(interest_income * 10 / 100, 2)::DECIMAL(24,2) + user_id % 3 AS l FROM totals WHERE user_id % 5 <> 0)",
        select="SELECT coalesce(p.user_id, d.user_id) AS user_id, v::DOUBLE AS portal_amount, l::DOUBLE AS ledger_amount, CASE WHEN v IS NULL THEN 'missing_in_portal' WHEN l IS NULL THEN 'missing_in_ledger' WHEN abs(v - l) <= 1 THEN 'matched' ELSE 'amount_mismatch' END AS kind FROM p FULL JOIN d ON p.user_id = d.user_id"),
    "b8_anti_exists": "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
}

#: Date columns, which come out as text.
DATES = {
    "d14_accounts_tree": ("first_start", "last_end"), "e4_recurring": ("last_seen", "next_expected"), "e5_net_worth": ("as_of_date",), "e6_latest_positions": ("as_of_date",),
    "e9_carried_dates": ("transaction_date",), "e13_expanded_periods": ("period_start", "period_end"), "f1_page": ("transaction_date",), "h13_search": ("transaction_date",),
    "c13_sms_statement_match": ("matched_date",), "j9_bills": ("due_date",),
}
for _name, _columns in DATES.items():
    ORACLE_SQL[_name] = f"SELECT * REPLACE ({', '.join(f'{c}::DATE::VARCHAR AS {c}' for c in _columns)}) FROM ({ORACLE_SQL[_name]})"

K = "SELECT txn_id AS k, * FROM walked"
VALID = f"""checked AS (
    SELECT *, trim(regexp_replace(merchant_raw, '\\s+', ' ', 'g')) AS told, date_trunc('month', transaction_date)::DATE AS first, 0.70::DOUBLE + (k % 5) / 20.0::DOUBLE AS confidence,
        list_filter([CASE WHEN k % 41 = 0 OR year(transaction_date) NOT BETWEEN 1990 AND 2003 THEN 'date_parse_failed' END, CASE WHEN k % 41 <> 0 AND transaction_date > DATE '2001-08-01' THEN 'date_not_future' END, CASE WHEN k % 43 = 0 THEN 'amount_parse_failed' END,
            CASE WHEN k % 43 <> 0 AND k % 47 = 0 THEN 'amount_max_2_decimal' END, CASE WHEN k % 53 = 0 THEN 'description_required' END], lambda x: x IS NOT NULL) AS hard,
        list_filter([CASE WHEN k % 41 <> 0 AND transaction_date > date_trunc('month', transaction_date)::DATE + 27 THEN 'date_within_statement_period' END, CASE WHEN balance_after < 0 THEN 'balance_negative' END, CASE WHEN k % 31 = 0 THEN 'cr_dr_resolved' END], lambda x: x IS NOT NULL) AS soft
    FROM ({K}))"""
STATUS = "CASE WHEN len(hard) > 0 THEN 'invalid' WHEN confidence < 0.75 THEN 'low_confidence' WHEN len(soft) > 0 THEN 'needs_review' ELSE 'valid' END"
PLAIN = "trim(regexp_replace(regexp_replace(upper(merchant_raw), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
WORDS = r"trim(regexp_replace(lower({0}), '[\s_\-/\\]+', ' ', 'g'))"
BANKS = "list_sort([" + ", ".join("{'least': -(" + " + ".join(f"CASE WHEN contains(low, {quoted(w)}) THEN {max(8, 6 * len(w.split()))} ELSE 0 END" for w in words) + f"), 'bank': {quoted(bank)}}}" for bank, words in rules.BANK_WORDS.items()) + "])[1]"
ORACLE_SQL |= {
    "h_scalars": with_(LEDGER, "x AS (SELECT *, last_day((date_trunc('month', transaction_date) + INTERVAL 1 MONTH)::DATE) AS next_last, year(transaction_date) - CASE WHEN month(transaction_date) < 4 THEN 1 ELSE 0 END AS fy FROM ledger)",
        select=f"""SELECT txn_id, {PLAIN} AS plain,
            coalesce(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(upper(merchant_raw), '[^A-Z\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND NOT list_contains({listed(rules.GENERIC_WORDS)}, w))[1:4], ' '), '') AS hint,
            lower(array_to_string(regexp_extract_all(merchant_raw, '[A-Za-z0-9]{{2,}}'), ' ')) AS tokens,
            repeat('X', (length(merchant_raw) - 4)::INT) || right(merchant_raw, 4) AS masked, trim(regexp_replace(lower(merchant_raw || '-' || account_masked), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
            amount::DOUBLE AS inr, amount::DOUBLE AS parsed, true AS two_decimals, txn_id % 2 = 0 AS credit, transaction_date AS day, printf('%04d-%02d', fy, (fy + 1) % 100) AS fy, next_last AS next_month FROM x"""),
    "i8_validated": with_(LEDGER, ROWS, VALID, select=f"SELECT txn_id, {STATUS} AS validation_status, array_to_string(hard || soft, ',') AS errors FROM checked"),
    "i13_hints": with_(LEDGER, f"t AS (SELECT txn_id, {WORDS.format("merchant_raw || ' ' || lower(bank_name) || CASE txn_id % 3 WHEN 0 THEN ' savings account statement' WHEN 1 THEN ' credit card' ELSE '' END")} AS low FROM ledger)", f"b AS (SELECT *, {BANKS} AS best FROM t)",
        select=f"SELECT txn_id, CASE WHEN best.least < 0 THEN best.bank END AS bank, CASE WHEN {says('low', rules.CARD_CUES)} THEN 'credit_card' WHEN {says('low', rules.BANK_CUES)} THEN 'bank_account' END AS account_type_hint FROM b"),
    "i19_sms_parsed": with_(LEDGER, "c AS (" + ORACLE_SQL["i18_sms_classes"].replace("WITH ", "WITH ", 1) + ")", "m19 AS (SELECT l.*, txn_id % 5 < 3 AS known FROM ledger l JOIN c ON sms_id = txn_id WHERE sms_class LIKE 'transaction%')",
        select="""SELECT txn_id AS sms_id, ['HDFC', 'ICICI', 'AXIS', 'UNKNOWN', 'UNKNOWN'][(txn_id % 5)::INT + 1] AS bank_name, CASE WHEN txn_id % 6 = 0 THEN 'XX1234' ELSE 'XX' || lpad((txn_id % 10000)::VARCHAR, 4, '0') END AS account_masked, amount::DOUBLE AS amount,
            CASE WHEN txn_id % 6 = 0 THEN amount::DOUBLE END AS balance_after, CASE WHEN txn_id % 6 = 0 THEN '123456789012' END AS reference_number, CASE WHEN txn_id % 6 = 0 THEN 'shop@okbank' END AS upi_id,
            round(least(1.0, 0.5 + CASE WHEN known THEN 0.25 ELSE 0 END + 0.1 + 0.1 + CASE WHEN txn_id % 6 = 0 THEN 0.05 ELSE 0 END)::DOUBLE, 2) AS confidence FROM m19"""),
    "j2_promotion_counts": with_(LEDGER, ROWS, VALID, f"s AS (SELECT *, {STATUS} AS status, CASE WHEN k % 31 = 0 THEN false ELSE direction = 'credit' END AS cr, k % 10 = 3 AS was, k % 17 = 4 AS again FROM checked)",
        f"d AS (SELECT *, (user_id, account_masked, transaction_date, amount, substr(lower(told), 1, 40)) AS key, (user_id, transaction_date, amount, substr({PLAIN.replace('merchant_raw', 'told')}, 1, 30)) AS sig FROM s)",
        "o AS (SELECT DISTINCT key, cr FROM d WHERE was AND status <> 'invalid')", "a AS (SELECT DISTINCT sig FROM d WHERE again AND status <> 'invalid')",
        "n AS (SELECT * FROM d WHERE status <> 'invalid' QUALIFY row_number() OVER (PARTITION BY key, cr ORDER BY statement_id, seq) = 1)",
        "c AS (SELECT statement_id, count(*) AS created FROM n WHERE (key, cr) NOT IN (SELECT key, cr FROM o) AND sig NOT IN (SELECT sig FROM a) GROUP BY ALL)",
        select="SELECT statement_id, count(*) AS rows, count(*) FILTER (status = 'invalid') AS invalid, coalesce(any_value(created), 0) AS created, count(*) - count(*) FILTER (status = 'invalid') - coalesce(any_value(created), 0) AS duplicates FROM d LEFT JOIN c USING (statement_id) GROUP BY ALL"),
    "j15_subscriptions": "WITH p AS (" + ORACLE_SQL["e4_recurring"] + "), q AS (SELECT *, (1000 + occurrences) * CASE frequency WHEN 'quarterly' THEN 4 WHEN 'yearly' THEN 1 ELSE 12 END AS yearly, next_expected::DATE - DATE '2001-08-01' AS days FROM p) SELECT user_id, merchant, round(yearly, 2)::DOUBLE AS annual_cost, round(yearly / 12.0, 2)::DOUBLE AS monthly_cost, days::BIGINT AS days_left, CASE WHEN days < 0 THEN 'overdue' WHEN days <= 7 THEN 'upcoming' ELSE 'scheduled' END AS status FROM q",
    "l10_hra": with_(TAXPAYERS, "h AS (SELECT user_id, (gross_salary * 100)::HUGEINT AS g, user_id % 4 IN (0, 2) AS metro, user_id % 50 * 900000 AS rent FROM taxpayers)", "i AS (SELECT *, (g + 2) // 5 AS hra, (g + 1) // 2 AS basic FROM h)",
        select="SELECT user_id, round(least(hra, CASE WHEN metro THEN (basic * 50 + 50) // 100 ELSE (basic * 40 + 50) // 100 END, greatest(rent - (basic * 10 + 50) // 100, 0))::DOUBLE / 100, 2) AS exemption FROM i"),
    "l14_simple_regime": with_(TAXPAYERS, "i AS (SELECT user_id, ((gross_salary * 100)::HUGEINT * 2 + 3) // 6 AS p FROM taxpayers)", "t AS (SELECT user_id, (p / 100.0)::DECIMAL(18,2) AS taxable FROM i)", "s AS (SELECT *, " + slab_sum("taxable", rules.NEW_SLABS["2023-24"]) + " AS base FROM t)",
        "r AS (SELECT *, CASE WHEN taxable <= 700000 THEN least(base, 25000) WHEN taxable <= 725000 THEN greatest(least(25000, base - (taxable - 700000)), 0) ELSE 0 END AS rebate FROM s)", "a AS (SELECT *, greatest(base - rebate, 0) AS after FROM r)",
        select="SELECT user_id, round(base::DOUBLE, 2) AS tax_before_rebate, round(rebate::DOUBLE, 2) AS rebate, round((after + floor(after * 4 + 0.5) / 100)::DOUBLE, 2) AS total_tax FROM a"),
    "c17_knowledge_rank": f"""WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, lang AS bank, lower(text[1]) AS kind, CASE WHEN n_chars >= 1000 THEN 2 ELSE 0 END AS more,
                   list_distinct(list_filter(regexp_extract_all({WORDS.format("coalesce(text, '')")}, '[a-z0-9]{{3,}}'), lambda w: NOT list_contains({listed(rules.STATEMENT_STOPWORDS)}, w) AND NOT regexp_full_match(w, '[0-9]+'))) AS words
            FROM documents),
        n AS (
            SELECT q.doc_id, r.doc_id AS ref_id, r.text, row_number() OVER (PARTITION BY q.doc_id ORDER BY r.doc_id DESC) AS k,
                   len(list_intersect(q.words, r.words)) + CASE WHEN q.bank = r.bank AND q.bank <> '' THEN 8 ELSE 0 END + CASE WHEN q.kind = r.kind AND q.kind <> '' THEN 5 ELSE 0 END + r.more AS score
            FROM d q JOIN d r ON q.doc_id <> r.doc_id),
        s AS (SELECT * FROM n WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY k) = 1)
        SELECT doc_id, ref_id, score::BIGINT AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ref_id DESC) AS place FROM s QUALIFY place <= 4""",
}


def _least_tax(changed: str) -> str:
    """The lesser total of 2025-26 by user, from the comparison of 2024-25: the years differ by the new regime's slabs and rebate."""
    sql = ORACLE_SQL["l7_compare_regimes"]
    for column in ("new_taxable", "nt"):
        sql = sql.replace(slab_sum(column, rules.NEW_SLABS["2024-25"]), slab_sum(column, rules.NEW_SLABS["2025-26"]))
    sql = sql.replace("new_taxable <= 700000 THEN least(new_slab_tax, 25000)", "new_taxable <= 1200000 THEN least(new_slab_tax, 60000)").replace("AS special FROM taxpayers", f"AS special FROM (SELECT * {changed} FROM taxpayers)")
    return sql[: sql.rindex("\nSELECT user_id, round(")] + "\nSELECT user_id, least(old_total, new_total) AS tax FROM f"


ORACLE_SQL["l12_what_if"] = (
    f"WITH b AS ({_least_tax('')}), p AS (SELECT 'full_80c' AS scenario, * FROM ({_least_tax('REPLACE (150000 AS d80c)')}) UNION ALL SELECT 'no_house', * FROM ({_least_tax('REPLACE (0 AS house_self, 0 AS house_let)')})) "
    "SELECT p.user_id, scenario, round(p.tax::DOUBLE, 2) AS tax, round((b.tax - p.tax)::DOUBLE, 2) AS saving FROM p JOIN b USING (user_id)"
)
