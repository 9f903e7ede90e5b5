"""Rows out of text."""

from brookledger.operators import extract


def test_statement_lines(spark):
    texts = ["01/04/2024 02/04/2024 UPI SHOP 500.00 9,500.00", "01-04-2024 NEFT SALARY 1,00,000.00 CR", "05 APR 2024 PAYMENT + C 2,000.00", "05/04/24 COFFEE 120.00 880.00", "05/04/24 BOOK C 99.00", "Opening balance 100.00", "", None]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, line_no int, text string")
    got = {r["line_no"]: tuple(r)[2:] for r in extract.statement_lines(df).collect()}
    assert got == {
        0: ("two_dates", "01/04/2024", "UPI SHOP", "500.00", "", "9,500.00"), 1: ("with_mark", "01-04-2024", "NEFT SALARY", "1,00,000.00", "CR", None),
        2: ("card_credit", "05 APR 2024", "PAYMENT", "2,000.00", "CR", None), 3: ("with_balance", "05/04/24", "COFFEE", "120.00", "", "880.00"), 4: ("plain", "05/04/24", "BOOK", "99.00", "", None),
    }


def test_tax_documents(spark):
    form = "Gross Salary: 15,00,000.00\nStandard Deduction 50,000\n80C ... 1,50,000 TDS: 1,20,000"
    df = spark.createDataFrame([(1, form), (2, None), (3, "")], "doc_id long, text string")
    assert {(r["head"], float(r["amount"])) for r in extract.form16_lines(df).collect()} == {("gross_salary", 1500000.0), ("standard_deduction", 50000.0), ("deduction_80c", 150000.0), ("tds", 120000.0)}
    ais = "HDFC BANK interest from savings bank: 12,345.50. Dividend received Rs 400"
    got = extract.ais_lines(spark.createDataFrame([(1, ais), (2, None)], "doc_id long, text string")).collect()
    assert {(r["category"], r["amount"], r["info_source"]) for r in got} == {("interest", 12345.5, "HDFC BANK"), ("dividend", 400.0, "HDFC BANK")}
    rows = extract.form26as_lines(spark.createDataFrame([(1, "ABCD12345E ACME LTD 192 1500000.00 150000.00 Challan: 1234567 paid 5,000.00")], "doc_id long, text string")).collect()
    a = next(r for r in rows if r["part"] == "A")
    assert (a["deductor_tan"], a["section"], a["amount_credit"], a["amount_tds"]) == ("ABCD12345E", "192", 1500000.0, 1234567.0)
    assert any(r["part"] == "C" for r in rows)
    assert extract.amounts_after(spark.createDataFrame([(1, ais), (2, "")], "doc_id long, text string"), ["interest", "dividend"]).orderBy("doc_id").first()["amount"] == 12745.5
