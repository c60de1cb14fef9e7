"""Files in, whole batches, reports and roll-ups out."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from talkgauge import schemas
from talkgauge.config import Settings
from talkgauge.plans.batch import build_script_vectors, build_term_importance, distinct_scripts, run_batch, summarize_only, write_distinct_scripts
from talkgauge.plans.coverage import Coverage
from talkgauge.sources import files, xlsx
from talkgauge.streaming import incremental

HEADER = "Speaker Roles,Transcription,Segment Start Time,Segment End Time\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("calls")
    (path / "1_x_E.csv").write_text(HEADER + 'SPEAKER_1,"Hello, this is the\nbank.",00:00:00,00:00:04\nSPEAKER_2,I want a refund please,00:00:05,00:00:09\nSPEAKER_1,Our refund policy covers this product.,00:00:10,00:00:20\n')
    (path / "2_x_C.csv").write_text(HEADER + "SPEAKER_1,請確認客戶身份資料,00:00:00,00:00:04\nSPEAKER_2,好,00:00:05,00:00:06\n", encoding="utf-8")
    (path / "3_x_M.csv").write_text(HEADER + "SPEAKER_1,请确认客户身份。,00:00:00,00:00:04\n", encoding="utf-8")
    (path / "4_x_E.csv").write_text(HEADER + "SPEAKER_1,,00:00:00,00:00:04\n")
    return path


@pytest.fixture(scope="module")
def scripts(spark):
    rows = [("Bond_ENG", 0, "Refund", "Our refund policy covers this product. Please confirm.", None), ("Bond_ENG", 1, "Greeting", "Hello this is the bank", None), ("Bond_CAN", 0, "身份", "請確認身份.核實客戶資料", None), ("Bond_MAN", 0, "身份", "请确认身份。", None)]
    return spark.createDataFrame(rows, schemas.SCRIPTS)


def test_workbook_round_trip(spark, tmp_path):
    tables = {"Bond_ENG": [["Required_Discussion_Point", "Standard_Script", "Points to Note"], ["P & <1>", 'say "x"', None], [None, None, None], ["P2", 12.5, "n"]], "Readme": [["a"], ["b"]]}
    (tmp_path / "s.xlsx").write_bytes(xlsx.workbook(tables))
    rows = files.script_workbook(spark, str(tmp_path)).orderBy("script_row").collect()
    assert [(r.sheet, r.point, r.standard_script, r.note) for r in rows] == [("Bond_ENG", "P & <1>", 'say "x"', None), ("Bond_ENG", "P2", "12.5", "n")]
    xlsx.register(spark)
    df = spark.read.format("xlsx").option("sheet", "*").load(str(tmp_path))
    assert df.count() == 3 and {"_sheet", "_row", "_file", "Standard_Script", "a"} <= set(df.columns)
    assert spark.read.format("xlsx").load(str(tmp_path / "s.xlsx")).count() == 2
    spark.createDataFrame([("x", 1), ("y", 2)], "a string, b int").coalesce(1).write.format("xlsx").mode("append").save(str(tmp_path / "out"))
    assert sorted(r.a for r in spark.read.format("xlsx").load(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_shared_strings(spark, tmp_path):
    source = zipfile.ZipFile(io.BytesIO(xlsx.workbook({"S": [["x"], ["y"]]})))
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as book:
        for name in source.namelist():
            book.writestr(name, source.read(name) if "sheet1" not in name else f'<worksheet xmlns="{xlsx._MAIN[1:-1]}"><sheetData><row><c r="B1" t="s"><v>0</v></c></row><row><c r="B2" t="s"><v>1</v></c></row></sheetData></worksheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{xlsx._MAIN[1:-1]}"><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
    assert [c for _, _, c in xlsx.records(str(tmp_path / "t.xlsx"), None)] == [{"_0": None, "head": "rich"}]


def test_transcripts(spark, folder):
    calls = files.transcripts(spark, str(folder))
    rows = {(r.call_id, r.row_idx): r for r in calls.collect()}
    assert rows[("1_x_E.csv", 0)].text == "Hello, this is the\nbank." and rows[("1_x_E.csv", 2)].end_time == "00:00:20" and len(rows) == 7
    assert [r.filename for r in files.list_transcripts(spark, str(folder)).collect()] == ["1_x_E.csv", "2_x_C.csv", "3_x_M.csv", "4_x_E.csv"]
    assert files.report_names(files.list_transcripts(spark, str(folder))).first().report == "1_x_E.xlsx"


def test_batch(spark, folder, scripts, tmp_path):
    mapping = spark.createDataFrame([(str(i), "Bond", None, i) for i in range(1, 5)], schemas.MAPPING)
    weights = build_term_importance(scripts)
    files.write_term_weights(weights, str(tmp_path / "terms"))
    stored = files.term_weights(spark, str(tmp_path / "terms"))
    assert stored.count() == weights.count() > 0 and files.term_weights(spark, str(tmp_path / "none")).count() == 0
    calls, names = files.transcripts(spark, str(folder)), files.list_transcripts(spark, str(folder))
    log = run_batch(spark, calls, names, mapping, scripts, str(tmp_path / "out"), term_table=stored)
    assert {r.filename: r.status for r in log.collect()} == {"1_x_E.csv": "SUCCESS", "2_x_C.csv": "SUCCESS", "3_x_M.csv": "SUCCESS", "4_x_E.csv": "ERROR"}
    english = {r.point: r for r in spark.read.parquet(str(tmp_path / "out/ENG/coverage")).filter("call_id = '1_x_E.csv'").collect()}
    assert english["Refund"].covered == "Covered" and english["Greeting"].covered == "Covered"
    cantonese = spark.read.parquet(str(tmp_path / "out/CAN/coverage")).first()
    assert cantonese.semantic > 0 and 0 <= cantonese.weighted_score <= 1
    summary = spark.read.parquet(str(tmp_path / "out/summary"))
    again = summarize_only(spark, str(tmp_path / "out"))
    assert summary.count() == again.count() == 3 and {r.total_mmss for r in summary.collect()} == {"00:20", "00:06", "00:04"}
    files.write_log(str(tmp_path / "log"), {"total": 4}, [], spark)
    assert spark.read.json(str(tmp_path / "log")).first().batch_summary.total == 4


def test_reports_stored_vectors_and_errors(spark, folder, scripts, tmp_path):
    """A workbook for each call and one for the batch; vectors are looked up first; every file is in the log, with the reason of an error."""
    mapping = spark.createDataFrame([("1", "Bond", None, 1), ("3", "Bond", None, 2), ("4", "Bond", None, 3), ("5", None, None, 4)], schemas.MAPPING)
    more = spark.createDataFrame([("x.csv",), ("2_x_Z.csv",), ("5_x_E.csv",)], "filename string")
    names = files.list_transcripts(spark, str(folder)).unionByName(more)
    build_script_vectors(scripts, "ENG", str(tmp_path / "vectors"))
    stored = spark.read.parquet(str(tmp_path / "vectors"))
    assert stored.count() == stored.select("clean_text").distinct().count() > 0
    calls = files.transcripts(spark, str(folder))
    log = run_batch(spark, calls, names, mapping, scripts, str(tmp_path / "out"), embeddings=stored, workbooks=True)
    got = {r.filename: (r.status, r.reason and r.reason.split()[1], r.language_name) for r in log.collect()}
    assert got["1_x_E.csv"] == ("SUCCESS", None, "English") and got["3_x_M.csv"] == ("SUCCESS", None, "Mandarin") and got["4_x_E.csv"] == ("ERROR", "groups,", "English")
    assert got["2_x_C.csv"][1] == "sample" and got["x.csv"][1] == got["2_x_Z.csv"][1] == "name" and got["5_x_E.csv"][0] == "ERROR" and len(got) == 7
    plain = run_batch(spark, calls, names, mapping, scripts, str(tmp_path / "plain"))
    scores = lambda path: {(r.call_id, r.point): round(r.weighted_score, 6) for r in spark.read.parquet(str(tmp_path / path / "ENG/coverage")).collect()}
    assert plain.count() == 7 and scores("out") == scores("plain")
    with zipfile.ZipFile(tmp_path / "out/ENG/reports/1_x_E.xlsx") as book:
        assert list(xlsx.sheets(book)) == ["Executive Summary", "Coverage Analysis", "Original Call Text"]
        summary, view, text = (list(xlsx.read_sheet(book, name)) for name in xlsx.sheets(book))
    first = [row[0] if row else None for row in summary]
    assert first[0] == "A. Overall Performance KPIs" and "B. Key Insights - Speaker View" in first and "C. Detailed Coverage List" in first
    assert ["Total Points Checked", "2"] in summary and ["Total Call Duration", "00:00:20"] in summary and ["Compliance Coverage Rate (%)", "100.0%"] in summary
    assert [row[0] for row in summary if row and row[0] in ("Sales", "Customer")] == ["Sales", "Customer"]
    at = first.index("C. Detailed Coverage List") + 2
    assert summary[at][:3] == ["Required_Discussion_Point", "Standard_Script", "Covered"] and [row[0] for row in summary[at + 1 :]] == ["Refund", "Greeting"]
    assert view[0][:3] == ["group_id", "speaker", "call_text"] and "Refund_Hit" in view[0] and len(view) == 4
    assert text[0][0] == "original_row" and [row[0] for row in text[1:]] == ["0", "1", "2"]
    rolled = [c for _, _, c in xlsx.records(str(tmp_path / "out/reports/Summarized_Analysis_Report.xlsx"), None)]
    assert {c["Sample No"] for c in rolled} == {"1", "3"} and set(rolled[0]) >= {"Coverage Rate (%)", "Customer WC Outlier"}
    assert spark.read.parquet(str(tmp_path / "out/outliers")).first().duration_outliers == 0
    write_distinct_scripts(scripts, str(tmp_path / "dedup"))
    assert sum(1 for _ in xlsx.records(str(tmp_path / "dedup/scripts_deduplicated.xlsx"), None)) == distinct_scripts(scripts).count()


def test_views_of_a_plan(spark, folder, scripts):
    tasks = spark.createDataFrame([("1_x_E.csv", "Bond_ENG", "Sales Call")], "call_id string, script_sheet string, call_type string")
    calls = files.transcripts(spark, str(folder)).filter("call_id = '1_x_E.csv'")
    plan = Coverage(calls, tasks, scripts, Settings("ENG"))
    view = plan.view("Bond_ENG")
    assert "Refund_Hit" in view.columns and view.count() == plan.groups.count()
    assert plan.kpis.first().total_duration == "00:00:20" and plan.detailed.count() == 2 and plan.sentences.count() == 3
    with pytest.raises(ValueError, match="speaker"):
        Coverage(calls.drop("speaker"), tasks, scripts)


def test_incremental(spark, folder, tmp_path):
    schema = "`Speaker Roles` string, Transcription string, `Segment Start Time` string, `Segment End Time` string"
    stream = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(str(folder))
    query = incremental.start(stream, lambda batch: batch.groupBy("Speaker Roles").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 7
