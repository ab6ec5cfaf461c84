import io
import zipfile
from collections import Counter
from datetime import datetime

import pytest

from tallyspark.config import GenerationSettings, StorageSettings, StreamSettings
from tallyspark.functions import parse
from tallyspark.operators import metrics
from tallyspark.schema import ORDER, PAYMENT, REFUND, SHEET_HEADERS, VIEW
from tallyspark.sources import events, generator, workbook


def test_generator_is_reproducible_and_plausible():
    settings = GenerationSettings(count=30_000)
    rows = list(generator.generate(settings))
    assert rows[:200] == list(generator.generate(GenerationSettings(count=200))) and len(rows) == 30_000
    assert abs(sum(g.duplicate for g in rows) / 30_000 - 0.05) < 0.01
    fresh = [g.event for g in rows if not g.duplicate]
    assert abs(Counter(e.event_type for e in fresh)[VIEW] / len(fresh) - 0.40) < 0.01
    ordered, paid = {}, {}
    for e in fresh:
        if e.event_type == ORDER:
            ordered[e.order_id] = e
        elif e.event_type in (PAYMENT, REFUND):
            before = (ordered if e.event_type == PAYMENT else paid)[e.order_id]
            assert (before.user_id, before.product_id, before.amount, before.quantity) == (e.user_id, e.product_id, e.amount, e.quantity) and e.event_time >= before.event_time
            paid[e.order_id] = e
    assert all(parse.parse_event(e.to_json().encode())[5] == e.amount for e in fresh[:500])
    none = list(generator.generate(GenerationSettings(count=500, duplicate_rate=0, out_of_order_rate=0)))
    assert not any(g.duplicate or g.late for g in none)


def test_generated_rows_and_stream(spark, tmp_path):
    rows = generator.generated(spark, GenerationSettings(count=300))
    counters = metrics.event_counters(rows).first()
    assert counters.sent == 300 and counters.duplicates > 0 and parse.valid(parse.parse_events(rows.drop("duplicate", "out_of_order"))).count() == 300
    spark.dataSource.register(generator.GeneratorSource)
    stream = spark.readStream.format("commerce-generator").option("count", 120).load()
    query = stream.writeStream.format("memory").queryName("made").option("checkpointLocation", str(tmp_path)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.table("made").count() == 120 and spark.table("made").select("offset").distinct().count() == 120


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot-json\n')
    rows = events.json_lines(spark, str(tmp_path / "x.jsonl")).collect()
    assert [bytes(r.value) for r in rows] == [b'{"a": 1}', b"not-json"]


def cell(ref, value, kind=""):
    return f'<c r="{ref}"{kind}><v>{value}</v></c>'


def book(rows, headers=SHEET_HEADERS, sheet="Online Retail", first=1):
    texts: list[str] = []

    def shared(value):
        texts.append(value)
        return len(texts) - 1

    lines = [f'<row r="{first}">' + "".join(cell(f"{chr(65 + k)}{first}", shared(h), ' t="s"') for k, h in enumerate(headers)) + "</row>"] + rows
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{t}</t></si>' for t in texts)}</sst>")
    return out.getvalue()


ROW = '<row r="2">' + cell("A2", 536365) + '<c r="B2" t="inlineStr"><is><t>85123A</t></is></c>' + cell("D2", "6") + cell("E2", "40513.351388888892", ' s="1"') + cell("F2", "2.5500") + cell("G2", "17850") + "</row>"


def test_workbook(spark, tmp_path):
    (row,) = workbook.read_workbook(book([ROW]))
    assert row[1] == "2" and row[3:] == ("536365", "85123A", "", "6", "2010-12-01T08:26", "2.55", "17850", "")
    (tmp_path / "b.xlsx").write_bytes(book([ROW]))
    spark.dataSource.register(workbook.WorkbookSource)
    read = spark.read.format("retail-workbook").load(str(tmp_path / "b.xlsx"))
    workbook.write_landing(read, str(tmp_path / "landing"))
    assert [tuple(r) for r in workbook.read_landing(spark, str(tmp_path / "landing")).collect()] == [tuple(x or None for x in row)]


def test_stored_workbook_on_any_filesystem(spark, tmp_path, monkeypatch):
    """By a path that only Spark's filesystems open, in batches, in the order of the sheet."""
    rows = [ROW.replace('"2"', f'"{n}"', 1).replace("2\" t", f'{n}" t').replace("A2", f"A{n}").replace("B2", f"B{n}").replace("D2", f"D{n}").replace("E2", f"E{n}").replace("F2", f"F{n}").replace("G2", f"G{n}") for n in range(2, 60)]
    (tmp_path / "b.xlsx").write_bytes(book(rows))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.books.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(workbook, "ROWS", 7)
    read = workbook.stored_workbook(spark, "viewfs://books/in/b.xlsx")
    assert [tuple(r) for r in read.collect()] == list(workbook.read_workbook((tmp_path / "b.xlsx").read_bytes())) and read.count() == 58


@pytest.mark.parametrize("data", [
    book([ROW], headers=("X", *SHEET_HEADERS[1:])), book([ROW], sheet="Other"), book([ROW.replace('r="2"', 'r="3"', 1)]), book(['<row r="2"><c r="A2"><f>1+1</f><v>2</v></c></row>']), book(['<row r="2">' + cell("I2", 1) + "</row>"]), book([], first=2),
])
def test_bad_workbooks(data):
    with pytest.raises(workbook.WorkbookError):
        list(workbook.read_workbook(data))


def test_settings():
    s = StreamSettings.load({"top-n": "5"}, {"TOP_N": "7", "PARALLELISM": "4"})
    assert (s.top_n, s.parallelism, s.out_of_order_ms) == (5, 4, 30_000)
    for bad in ({"top_n": 0}, {"parallelism": 129}, {"input_topic": "x", "dead_letter_topic": "x"}, {"out_of_order_ms": -1}, {"checkpoint_interval_ms": 999}, {"checkpoint_directory": "relative"}):
        with pytest.raises(ValueError):
            StreamSettings(**bad)
    assert "secret" not in repr(StorageSettings(password="secret"))
    with pytest.raises(ValueError):
        StorageSettings(result_version=0)
    with pytest.raises(ValueError):
        GenerationSettings(duplicate_rate=float("nan"))
    assert GenerationSettings().start_time == datetime.fromisoformat("2026-01-15T10:00:00+00:00")
