"""Readers of vendor files: round trips, partitions within a file, formats by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from channelflow.sources import brainvision as B
from channelflow.sources import matlab as M
from channelflow.sources import sheets as X

NAMES = ["Fp1", "a,b", "Cz"]


@pytest.mark.parametrize("kind, multiplexed", [("INT_16", True), ("IEEE_FLOAT_32", False), ("INT_32", False), ("IEEE_FLOAT_64", True)])
def test_recordings_round_trip_in_ranges(spark, tmp_path, kind, multiplexed):
    rng = np.random.default_rng(1)
    data = {f"s{i}": np.round(rng.standard_normal((n, 3)) * 50, 1) for i, n in enumerate((1000, 37, 0))}
    for name, x in data.items():
        B.write_recording(str(tmp_path), name, x, NAMES, kind=kind, multiplexed=multiplexed)
    df = B.read_brainvision(spark, str(tmp_path), rows=256)
    assert df.rdd.getNumPartitions() == 5  # four of the first recording, one of the second, none of the empty one
    rows = df.collect()
    for name, x in data.items():
        own = sorted((r["t"], r["v"]) for r in rows if r["subject"] == name)
        assert [t for t, _ in own] == list(range(len(x))) and (not len(x) or np.abs(np.array([v for _, v in own]) - x).max() < 1e-4)
    assert B.read_brainvision(spark, f"file://{tmp_path}/s1.vhdr").count() == 37
    channels = B.brainvision_channels(spark, str(tmp_path)).where("subject = 's0'").orderBy("ch").collect()
    assert [tuple(r) for r in channels] == [("s0", i, n, 0.1, "µV") for i, n in enumerate(NAMES)]


def test_markers_name_stretches(spark, tmp_path):
    marks = [("New Segment", "", 0, 1, 0), ("Stimulus", "S 1", 5, 1, 0), ("Stimulus", "rest, eyes open", 12, 3, 0), ("Stimulus", "S 1", 12, 1, 2)]
    B.write_recording(str(tmp_path), "one", np.ones((20, 3)), NAMES, markers=tuple(marks))
    B.write_recording(str(tmp_path), "two", np.ones((3, 3)), NAMES)
    markers = B.brainvision_markers(spark, str(tmp_path))
    assert [tuple(r)[2:] for r in markers.orderBy("marker").collect()] == [(k, d, t, n, c) for k, d, t, n, c in marks]
    got = B.marked_stretches(B.read_brainvision(spark, str(tmp_path)), markers).orderBy("subject", "t").collect()
    assert [r["task"] for r in got] == [None] * 5 + ["S 1"] * 7 + ["S 1"] * 8 + [None] * 3


def test_faulty_recordings_are_errors(spark, tmp_path):
    B.write_recording(str(tmp_path), "one", np.ones((4, 3)), NAMES)
    (tmp_path / "one.eeg").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole number of samples"):
        B.read_brainvision(spark, str(tmp_path)).count()
    with pytest.raises(ValueError, match="binary"):
        B.Header.parse("[Common Infos]\nNumberOfChannels=1\nDataFile=x\nDataFormat=ASCII\n")
    with pytest.raises(ValueError, match="format"):
        B.Header.parse("[Common Infos]\nNumberOfChannels=1\nDataFile=x\n[Binary Infos]\nBinaryFormat=UINT_7\n")
    plain = B.Header.parse("Title\n; note\n[Common Infos]\nNumberOfChannels=2\nDataFile=x.dat\n[Channel Infos]\nCh2=Oz,ref,,\n")
    assert plain.names == ("Ch1", "Oz") and plain.resolutions == (1.0, 1.0) and plain.multiplexed and plain.kind == "INT_16"


@pytest.mark.parametrize("deflate", [True, False])
@pytest.mark.parametrize("order", ["<", ">"])
def test_mat_files_round_trip(spark, tmp_path, deflate, order):
    rng = np.random.default_rng(2)
    given = {"rest": rng.standard_normal((3, 50)), "t": rng.standard_normal((3, 7)), "__meta": np.ones((1, 1))}
    (tmp_path / "s1.mat").write_bytes(M.mat_bytes(given, deflate, order))
    rows = M.read_mat(spark, str(tmp_path)).collect()
    assert {r["task"] for r in rows} == {"rest", "t"} and {r["subject"] for r in rows} == {"s1"}
    for name in ("rest", "t"):
        own = sorted((r["t"], r["v"]) for r in rows if r["task"] == name)
        assert (np.array([v for _, v in own]).T == given[name]).all()
    assert M.read_mat(spark, str(tmp_path), ["t"]).agg(F.count("*")).first()[0] == 7
    assert M.read_mat(spark, str(tmp_path), ["t"], channels_first=False).count() == 3
    with pytest.raises(Exception, match="no such task: gone"):
        M.read_mat(spark, str(tmp_path), ["gone"]).count()


def test_mat_elements_by_hand():
    """Whole numbers stored narrower than their class, a short element within its tag, and a text that is left out."""

    def element(kind, content):
        return struct.pack("<II", kind, len(content)) + content + b"\0" * (-len(content) % 8)

    def variable(klass, name, shape, kind, content):
        short = struct.pack("<I", len(name) << 16 | 1) + name.ljust(4, b"\0")
        return element(14, element(6, struct.pack("<II", klass, 0)) + element(5, struct.pack("<ii", *shape)) + short + element(kind, content))

    head = b"x".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    raw = head + variable(6, b"n", (2, 3), 2, bytes([1, 2, 3, 4, 5, 6])) + variable(4, b"txt", (1, 2), 4, b"a\0b\0")
    found = dict(M.matrices(raw))
    assert list(found) == ["n"] and found["n"].tolist() == [[1, 3, 5], [2, 4, 6]]
    with pytest.raises(ValueError, match="version"):
        list(M.matrices(b"x".ljust(124) + struct.pack("<H", 0x0200) + b"IM"))
    with pytest.raises(ValueError, match="cut off"):
        list(M.matrices(raw[:180]))


def test_workbooks_round_trip(spark, tmp_path):
    rows = [["plan & <a>", None, 3, 2.5], [], ["x", *[None] * 27, "far"], [None, -1e20]]
    (tmp_path / "one.xlsx").write_bytes(X.workbook_bytes({"first": rows, "second": [["y"]]}))
    got = X.read_sheets(spark, str(tmp_path)).collect()
    want = {("first", 1, 1, "plan & <a>", None), ("first", 1, 3, "3", 3.0), ("first", 1, 4, "2.5", 2.5), ("first", 3, 1, "x", None), ("first", 3, 29, "far", None), ("first", 4, 2, "-1e+20", -1e20), ("second", 1, 1, "y", None)}
    assert {tuple(r)[1:] for r in got} == want and {r["file"] for r in got} == {"one"}
    assert X.read_sheets(spark, str(tmp_path), "second").count() == 1
    assert {tuple(r)[2:4]: None for r in X.sheet_rows(X.read_sheets(spark, str(tmp_path), "first")).select("file", "sheet", "row", F.array_join("values", "|").alias("v")).collect()}.keys() == {(1, "plan & <a>|3|2.5"), (3, "x|far"), (4, "-1e+20")}
    assert [X.column_number(X.column_letters(n)) for n in (1, 26, 27, 702, 703)] == [1, 26, 27, 702, 703]


def test_shared_strings_and_cells_without_places(tmp_path):
    import io
    import zipfile

    given = X.workbook_bytes({"s": [["gone"]]})
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(given)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            content = old.read(name).decode()
            if name.endswith("sheet1.xml"):
                content = f'<worksheet xmlns="{X.MAIN[1:-1]}"><sheetData><row><c t="s"><v>1</v></c><c><v>4</v></c><c/></row><row><c t="e"><v>#N/A</v></c><c t="b"><v>1</v></c></row></sheetData></worksheet>'
            new.writestr(name, content)
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{X.MAIN[1:-1]}"><si><t>a</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>')
    assert list(X.cells(out.getvalue())) == [("s", 1, 1, "two runs", None), ("s", 1, 2, "4", 4.0), ("s", 2, 1, "#N/A", None), ("s", 2, 2, "1", None)]


def test_trial_sheets_name_segments(spark, tmp_path):
    rows = [["sub1", "Name", "Start", "End"], ["rest", 10, 20], ["task", "30, 50", "40,60", "note"], ["empty"], [None, "late", 5, 9]]
    (tmp_path / "trials.xlsx").write_bytes(X.workbook_bytes({"sub1": rows}))
    got = {tuple(r) for r in X.trial_segments(X.read_sheets(spark, str(tmp_path))).collect()}
    assert got == {("trials", "sub1", "rest", 0, 10, 20), ("trials", "sub1", "task", 0, 30, 40), ("trials", "sub1", "task", 1, 50, 60), ("trials", "sub1", "late", 0, 5, 9)}
    (tmp_path / "bad.xlsx").write_bytes(X.workbook_bytes({"s": [["t", "1,2", "3"]]}))
    with pytest.raises(Exception, match="differ in number"):
        X.trial_segments(X.read_sheets(spark, str(tmp_path))).count()


def test_markers_of_many_blocks(spark):
    """A sample meets the markers of its block of time: those that hold from far before, several at one time, before the first sample and after the last."""
    marks = [("r", 1, "Stimulus", "early", -5), ("r", 2, "Stimulus", "a", 3), ("r", 3, "Stimulus", "b", 3), ("r", 4, "Other", "no", 7), ("r", 5, "Stimulus", "c", 200), ("r", 6, "Stimulus", "late", 900), ("q", 1, "Stimulus", "z", 10)]
    markers = spark.createDataFrame(marks, "subject string, marker int, kind string, description string, t long")
    samples = spark.range(300).selectExpr("explode(array('r', 'q', 'none')) AS subject", "id AS t", "array(1.0D) AS v")
    for block in (1, 64, 1000):
        got = {(r["subject"], r["t"]): r["task"] for r in B.marked_stretches(samples, markers, block=block).collect()}
        assert len(got) == 900
        assert [got["r", t] for t in (0, 2, 3, 199, 200, 299)] == ["early", "early", "b", "b", "c", "c"]
        assert [got["q", t] for t in (0, 9, 10, 299)] == [None, None, "z", "z"] and got["none", 5] is None
