"""Row-level operators, splits, vocabulary and features on hand-made rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logloom.functions import text
from logloom.operators import annotate, features, profile, splits, vocab
from logloom.sources import logs, sequences, xml
from parity import compare


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_masks(spark):
    masked = text.mask_content(F.lit("Ip=10.0.0.1|free 12 text|H=0x3e7"))
    assert one(spark, masked) == "Ip=<*>|free <*> text|H=<*>"
    assert one(spark, text.mask_content(F.lit("a blk_-12 /x/y"), text.MASKS["hdfs_drain"])) == "a blk_<*> <*>"


def test_text_functions(spark):
    assert one(spark, text.drop_leading_channel(F.lit("Channel=Security;A=1;;B=2"))) == "A=1;B=2"
    assert one(spark, text.drop_leading_channel(F.lit("Channel=Security;"))) is None
    assert one(spark, text.tokenize(F.lit("  a  b\tc "))) == ["a", "b", "c"]
    assert one(spark, text.tokenize(F.lit(" "))) == []
    assert one(spark, text.tokenize_on_punctuation(F.lit("a b=<*>;é,\\x"))) == ["a b", "<*>", "<NASCII>", "\\x"]
    assert one(spark, text.clean_text(F.lit(" a\r\nb "))) == "ab"
    assert one(spark, text.pad_time(F.lit("2024-01-01 00:00:00.5"))) == "2024-01-01 00:00:00.500000"
    assert one(spark, text.binary_label(F.lit(None).cast("string"))) == 1
    assert one(spark, text.binary_label(F.lit("-"))) == 0
    assert one(spark, text.template_id(F.lit("a <*>"))) == one(spark, F.substring(F.md5(F.lit("a <*>")), 1, 8))
    assert one(spark, text.block_ids(F.lit("blk_1 blk_-2 blk_1"))) == ["blk_1", "blk_-2"]


XML = """<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System>
<Provider Name="P" Guid="{g}"/><EventID Qualifiers="">4624</EventID>
<TimeCreated SystemTime="2024-01-01 00:00:00.100000"/><Channel>Security</Channel></System>
<EventData><Data Name="A">1</Data><Data Name="B"/><Data Name="C">z</Data><Data Name="A">2</Data></EventData></Event>"""


def test_event_xml(spark, rows):
    events = rows([(XML,)], "xml string").select(xml.parse_event("xml").alias("event"))
    fields = xml.event_fields(events).first()["fields"]
    assert fields == {
        "Provider_Name": "P", "Provider_Guid": "{g}", "EventID": "4624", "Channel": "Security",
        "TimeCreated_SystemTime": "2024-01-01 00:00:00.100000", "A": "2", "C": "z", "Content": "A=1|C=z|A=2",
    }
    old = xml.event_fields_channel_in_content(events).first()["fields"]
    assert old["Content"] == "Channel=Security;A=1;C=z;A=2" and "A" not in old and "Channel" not in old


ODD_XML = """<?xml version="1.0"?><e:Event xmlns:e="http://x"><e:System>
  <!-- <Extra>no</Extra> --><Provider Name='P "q"' Guid="a>b"/><EventID Qualifiers="1">0462</EventID>
  <TimeCreated SystemTime="t" RawTime="17" ></TimeCreated><Execution ProcessID="4" SessionID="9"/><Extra> R&amp;D &lt;x&gt; &#233;&#x1F642; </Extra>
  <Extra>last &amp;lt;</Extra><Nested a="1" xmlns="u"><In>x</In></Nested><Empty/><Channel><![CDATA[Se<c & "d"]]></Channel></e:System>
  <e:EventData><Data>none</Data><Data Name="A">1<![CDATA[]]></Data><Other Name="B">2</Other></e:EventData></e:Event>"""


def test_every_child_of_system(spark, rows):
    events = rows([(ODD_XML,), (None,), ("junk <System",), ("<Event><System/></Event>",)], "xml string").select(xml.parse_event("xml").alias("event"))
    first, *others = (r["fields"] for r in xml.event_fields(events).collect())
    assert first == {
        "Provider_Name": 'P "q"', "Provider_Guid": "a>b", "EventID": "0462", "TimeCreated_SystemTime": "t", "TimeCreated_RawTime": "17",
        "Execution_ProcessID": "4", "Execution_SessionID": "9", "Extra": "last &lt;", "Nested_a": "1", "Channel": 'Se<c & "d"', "A": "1", "Content": "A=1",
    }
    assert all(o == {"Content": ""} for o in others)
    assert xml.event_fields_channel_in_content(events).first()["fields"]["Content"] == 'Channel=Se<c & "d";A=1'


def test_event_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Events>" + XML + "\n" + XML.replace("Event>", "Event>") + "</Events>\n")
    found = xml.event_fields(xml.read_event_files(spark, str(tmp_path))).collect()
    assert len(found) == 2 and {r["fields"]["EventID"] for r in found} == {"4624"}


def test_common_and_all_fields(rows):
    df = rows([({"a": "1", "b": "2", "Content": "x"},), ({"a": "1", "c": "2", "Content": "y"},)], "fields map<string,string>")
    assert {r[0] for r in xml.field_names(df).collect()} == {"a", "Content"}
    assert {r[0] for r in xml.field_names(df, common=False).collect()} == {"a", "b", "c", "Content"}
    assert xml.common_table(df, common=False).filter("b = ''").count() == 1


def test_log_format(rows):
    df = rows([(1, "- 2024 boot: up and running "), (2, "junk"), (3, "A 2025   x: y: z")], "line long, raw string")
    out = logs.parse_log_format(df, "<Label> <Date> <Part>: <Content>").orderBy("LineId").collect()
    assert [tuple(r) for r in out] == [(1, "-", "2024", "boot", "up and running"), (2, "A", "2025", "x", "y: z")]


def test_split_columns(rows):
    df = rows([(1, " a b c  d e"), (2, "a b"), (3, "a")], "line long, raw string")
    out = logs.split_columns(df, ["x", "y", "z"]).orderBy("line").collect()
    assert [tuple(r)[1:] for r in out] == [("a", "b", "c  d e"), ("a", "b", ""), ("a", "", None)]


def test_every_nth(rows):
    df = rows([(i + 1,) for i in range(10)], "line long")
    assert [r["line"] - 1 for r in logs.every_nth(df, 3, 3).orderBy("line").collect()] == [0, 3, 6]


def test_read_lines_in_file_order(spark, rows, tmp_path):
    for name, lines in (("a.txt", ["x", "y"]), ("b.txt", ["z"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    got = logs.read_text_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [tuple(r) for r in got] == [(1, "x"), (2, "y"), (3, "z")]


def test_sequence_tokens(spark):
    got = one(spark, sequences.sequence_tokens(F.lit("e1,5.0 e2,1.5 e3 ")))
    assert [tuple(t) for t in got] == [("e1", 0.0), ("e2", 1.5), ("e3", 0.0)]


def test_annotations(rows):
    log = rows([(1, "a"), (2, "b"), (3, None)], "EventRecordID long, v string")
    marks = rows([("Sec", 1), ("Sec", 1), ("App", 2)], "Channel string, EventRecordID long")
    got = {r["EventRecordID"]: r["Label"] for r in annotate.annotate_by_id(log, marks).collect()}
    assert got == {1: "anomaly", 2: "-", 3: "-"}
    same = annotate.annotate_by_row(log, log.filter("EventRecordID > 1"), ["v"]).collect()
    assert {r["EventRecordID"]: r["Label"] for r in same} == {1: "-", 2: "anomaly", 3: "-"}
    sessions = rows([("s",), ("t",), ("u",)], "session_id string")
    labels = rows([("s", "Anomaly"), ("t", "Normal")], "session_id string, Label string")
    got = {r["session_id"]: r["label"] for r in annotate.label_sessions(sessions, labels).collect()}
    assert got == {"s": 1, "t": 0, "u": None}
    with pytest.raises(Exception):
        annotate.label_sessions(sessions, labels, strict=True).collect()


def test_stratified_allocation(rows):
    def alloc(counts, target):
        df = rows(list(counts.items()), "stratum string, n long")
        return {r["stratum"]: r["alloc"] for r in splits.allocate_strata(df, "stratum", target).collect()}

    assert alloc({"a": 6, "b": 3, "c": 1}, 5) == {"a": 2, "b": 2, "c": 1}

    def loop(counts, target):
        order = sorted(counts, key=lambda s: (-counts[s], s))
        total = sum(counts.values())
        out = {s: 1 + round(counts[s] / total * (target - len(counts))) for s in order}
        i = 0
        while sum(out.values()) != target:
            s, step = order[i % len(order)], 1 if sum(out.values()) < target else -1
            if step > 0 or out[s] > 1:
                out[s] += step
            i += 1
        return out

    for counts, target in (({c: 5 for c in "abcdefg"}, 10), ({c: 1 for c in "abcdef"}, 9), ({"a": 100, "b": 50, "c": 50, "d": 1}, 7)):
        assert alloc(counts, target) == loop(counts, target)
    with pytest.raises(Exception):
        alloc({"a": 1, "b": 1}, 1)


@pytest.mark.parametrize("kinds", [110, 119, 120, 121, 155, 400])
def test_allocation_like_its_sql_with_any_number_of_strata(spark, tmp_path, kinds):
    """A stratum is a type and a class of values, so a larger log has more of them than the target."""
    data = [(k, "view" if s % 3 else "click", 25.0 * s) for k, s in enumerate(s for s in range(1, kinds + 1) for _ in range(1 + 3000 // s**2))]
    data.append((len(data), "view", 3.0))
    frame = spark.createDataFrame(data, "event_id long, event_type string, value double")
    frame = frame.withColumns({"ts": F.timestamp_seconds("event_id"), "user_id": F.col("event_id") % 9})
    frame.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events"))
    next((tmp_path / "events").glob("*.parquet")).rename(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    fault = compare(spark, con, str(tmp_path), entry.queries()["l6_allocation"], entry.oracle_sql()["l6_allocation"])
    assert fault is None, fault


def test_uniform_split(rows):
    df = rows([(i, int(i < 4)) for i in range(10)], "line long, y int")
    got = splits.first_share(df, "line", 0.5, ["y"]).filter("split = 'train'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {1: 2, 0: 3}


def test_two_samples_share_no_row(rows):
    df = rows([(i, "abc"[i % 3]) for i in range(60)], "line long, s string")
    first, second = splits.two_disjoint_samples(df, "s", "line", 12)
    a, b = {r["line"] for r in first.collect()}, {r["line"] for r in second.collect()}
    assert len(a) == len(b) == 12 and not a & b
    with pytest.raises(Exception):
        splits.two_disjoint_samples(df, "s", "line", 40)


def test_vocabulary(rows):
    tokens = rows([(t,) for t in "b a b c".split()], "token string")
    v = {r["token"]: r["idx"] for r in vocab.build_vocab(tokens, max_size=2).collect()}
    assert v == {"<pad>": 0, "<unk>": 1, "<eos>": 2, "<sos>": 3, "<mask>": 4, "b": 5, "a": 6}
    table = vocab.build_vocab(tokens, max_size=2)
    seqs = rows([(1, ["b", "z"])], "k long, events array<string>")
    out = vocab.encode_arrays(seqs, table, ["k"], seq_len=6, with_eos=True, with_sos=True).first()
    assert (out["ids"], out["length"]) == ([3, 5, 1, 2, 0, 0], 4)
    more = vocab.extend_vocab(table, rows([("z", 9, 1), ("b", 5, 1), ("y", 6, 1)], "token string, idx long, freq long"))
    assert {r["token"]: r["idx"] for r in more.collect()} == {**v, "y": 7, "z": 8}


def test_next_labels(rows):
    df = rows([(0, "y"), (1, "x"), (2, "y"), (3, "#Pad")], "at long, next string")
    assert {r["label"]: r["idx"] for r in vocab.next_label_index(df, ["at"]).collect()} == {"y": 2, "x": 3, "#Pad": 1}


def test_mask_share(rows):
    df = rows([("s", i, 7, 1.0) for i in range(4000)], "seq_id string, pos long, idx long, dt double")
    out = vocab.mask_rows(df, 0.65, 20, predict=False).agg(
        F.avg((F.col("bert_label") > 0).cast("int")).alias("m"),
        F.avg((F.col("bert_input") == 4).cast("int")).alias("k"),
    ).first()
    assert abs(out["m"] - 0.65) < 0.03 and abs(out["k"] - 0.52) < 0.04


def test_validators(rows):
    df = rows([("e1,0.0 e2,nan e3",)], "raw string")
    out = profile.validate_event_gaps(df).first()
    assert (out["total_pairs"], out["nan_count"], out["parse_error_count"], out["verdict"]) == (2, 1, 1, "FAIL")
    numbers = rows([("1,2 1_0",), ("",), ("1f",), ("-Infinity",), ("2e7 .5 3.",)], "raw string")
    out = profile.validate_numbers(numbers).first()
    assert (out["total_values"], out["inf_count"], out["parse_error_count"], out["large_value_count"]) == (7, 1, 1, 1)
    assert (out["valid_lines"], out["invalid_lines"], out["median"]) == (3, 2, 2.5)


def test_length_stats_of_an_absent_split(rows):
    df = rows([("a", 3), ("a", 5)], "split string, n long")
    got = {r["split"]: r for r in profile.length_stats(df, ["a", "b"]).collect()}
    assert math.isclose(got["a"]["std"], math.sqrt(2)) and got["b"]["count"] == 0 and got["b"]["mean"] == 0


def test_tf_idf(rows):
    x = rows([("s", "e", 3.0)], "seq_id string, event string, x double")
    df = rows([("e", 1)], "event string, df long")
    out = features.tf_idf(x, df, rows([("s",), ("t",)], "seq_id string")).first()
    assert abs(out["x"] - 3 * math.log(2 / (1 + 1e-8))) < 1e-9
