"""Workbooks that are written by hand, read as rows."""

import random
from xml.sax.saxutils import escape
from zipfile import ZIP_DEFLATED, ZipFile

import pytest

from brookledger.operators import filing
from brookledger.sources import workbooks

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def letters(k):
    return (letters(k // 26 - 1) if k >= 26 else "") + chr(65 + k % 26)


def save(path, sheets):
    """sheets: name -> {row_no: {column: text}}; every second cell is a shared string, others are inline or numbers."""
    shared, parts = [], []
    for rows in sheets.values():
        out = []
        for n, cells in rows.items():
            told = []
            for c, v in cells.items():
                ref = f"{letters(c)}{n}"
                if v.replace(".", "").isdigit():
                    told.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif (c + n) % 2:
                    told.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
                else:
                    shared.append(v)
                    told.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
            out.append(f'<row r="{n}">{"".join(told)}</row>')
        parts.append(f'<worksheet {NS}><sheetData>{"".join(out)}</sheetData></worksheet>')
    with ZipFile(path, "w", ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><r><t>{escape(s[:2])}</t></r><r><t>{escape(s[2:])}</t></r></si>" for s in shared) + "</sst>")
        for k, p in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/sheet{k}.xml", p)


@pytest.mark.parametrize("most", [workbooks.TASK_BYTES, 1])
def test_rows(spark, tmp_path, most):
    """With one byte a task, every sheet is a task of its own."""
    rng, want = random.Random(2), set()
    (tmp_path / "deep").mkdir()
    for k in range(5):
        sheets = {f"S&{k} {s}": {n: {c: rng.choice(["a < b", "12.5", "Zürich", "x"]) for c in sorted(rng.sample(range(30), 3))} for n in sorted(rng.sample(range(1, 500), 40))} for s in range(3)}
        path = tmp_path / ("deep" if k % 2 else "") / f"b{k}.XLSX"
        save(path, sheets)
        for name, rows in sheets.items():
            want |= {(str(path), name, n, tuple(cells.get(c) for c in range(max(cells) + 1))) for n, cells in rows.items()}
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("x")
    spark.dataSource.register(workbooks.Workbooks)
    df = spark.read.format("workbooks").option("taskBytes", most).load(f"file://{tmp_path}")
    assert {(r["path"].removeprefix("file://"), r["sheet"], r["row_no"], tuple(r["cells"])) for r in df.collect()} == want
    assert df.rdd.getNumPartitions() == (15 if most == 1 else 1)
    assert spark.read.format("workbooks").load(f"file://{tmp_path}/deep").count() == 240


def test_texts(spark, tmp_path):
    save(tmp_path / "t.xlsx", {"One": {1: {0: "Buy Quantity", 2: "Sell"}, 3: {1: "5"}}, "Two": {1: {0: " end "}}})
    spark.dataSource.register(workbooks.Workbooks)
    texts = workbooks.workbook_texts(spark.read.format("workbooks").load(f"file://{tmp_path}"))
    assert [r["text"] for r in texts.collect()] == ["One\nBuy Quantity Sell\n5\nTwo\nend"]
    from pyspark.sql import functions as F

    hints = {c: F.lit(None).cast("string") for c in ("bank_hint", "document_type_hint", "account_type_hint")}
    assert filing.classified(texts.withColumnRenamed("path", "file_name").withColumns(hints)).first()["doc_type"] == "demat_trade_report"
