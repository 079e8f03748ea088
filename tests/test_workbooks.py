"""Workbooks written by hand, as their parts are plain XML."""

import tracemalloc
import zipfile
from xml.sax.saxutils import escape

import pytest

from kasauti.sources import workbooks

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def letter(n):
    return (letter(n // 26 - 1) if n >= 26 else "") + chr(65 + n % 26)


def cell(value, col, row, shared):
    at = f'r="{letter(col)}{row}"'
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c {at} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c {at}><v>{value}</v></c>"
    if value.startswith("inline:"):
        return f'<c {at} t="inlineStr"><is><t>{escape(value[7:])}</t></is></c>'
    shared.setdefault(value, len(shared))
    return f'<c {at} t="s"><v>{shared[value]}</v></c>'


def write(path, rows, name="sheet7.xml", other=None):
    """``rows`` as the first sheet; ``other`` as a sheet whose file's name sorts before it."""
    shared = {}
    sheet = lambda own: f"{HEAD}<worksheet {NS}><cols><col/></cols><sheetData>" + "".join(f'<row r="{r}">{"".join(cell(v, c, r, shared) for c, v in enumerate(x))}</row>' for r, x in enumerate(own, 1)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(f"xl/worksheets/{name}", sheet(rows))
        book.writestr("xl/worksheets/sheet1.xml" if other else "xl/worksheets/zzz.xml", sheet(other or []))
        rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        book.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS} {rel}><sheets><sheet name="a" r:id="rId9"/><sheet name="b" r:id="rId1"/></sheets></workbook>')
        links = "http://schemas.openxmlformats.org/package/2006/relationships"
        book.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="{links}"><Relationship Id="rId9" Target="worksheets/{name}"/><Relationship Id="rId1" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        if shared:
            book.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>" + "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t xml:space='preserve'>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" for s in shared) + "</sst>")


def test_many_workbooks_in_a_folder(spark, tmp_path):
    for k in range(5):
        header = ["claim", "label", None, "evidence"] if k % 2 == 0 else ["evidence", "claim"]
        rows = [["दावा & <x>", True, 3, f"inline:e{k}"], [None, 1.5], [], ["b" * 40_000, "SUP"]] if k % 2 == 0 else [["e", "दावा"], [None, None, "more"]]
        write(tmp_path / f"book{k}.xlsx", [header, *rows], other=[["not"], ["this"]])
    (tmp_path / "~$book0.xlsx").write_bytes(b"a lock")
    (tmp_path / "notes.txt").write_text("no workbook")
    df = workbooks.read_xlsx(spark, str(tmp_path))
    assert df.columns == ["claim", "label", "_c2", "evidence"] and df.rdd.getNumPartitions() == 5
    expected = []
    for k in range(5):
        expected += [("दावा & <x>", "True", "3", f"e{k}"), (None, "1.5", None, None), (None,) * 4, ("b" * 40_000, "SUP", None, None)] if k % 2 == 0 else [("दावा", None, None, "e"), (None,) * 4]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected))
    some = workbooks.read_xlsx(spark, f"file://{tmp_path}/book[13].xlsx", "claim string, domain string")
    assert sorted(map(tuple, some.collect()), key=repr) == sorted([("दावा", None), (None, None)] * 2, key=repr)
    assert workbooks.read_xlsx(spark, str(tmp_path / "book1.xlsx")).count() == 2


def test_none_and_doubled_columns(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert workbooks.read_xlsx(spark, str(tmp_path / "empty"), "claim string").count() == 0
    with pytest.raises(Exception, match="no/where"):
        workbooks.read_xlsx(spark, "/no/where").collect()
    write(tmp_path / "twice.xlsx", [["a", "A"], ["1", "2"]])
    with pytest.raises(Exception, match="twice"):
        workbooks.read_xlsx(spark, str(tmp_path / "twice.xlsx")).collect()
    write(tmp_path / "bare.xlsx", [])
    assert workbooks.read_xlsx(spark, str(tmp_path / "bare.xlsx"), "a string").count() == 0


def test_memory_does_not_follow_the_sheet(tmp_path):
    """Ten times the rows take no more memory."""
    peaks = []
    for n in (4_000, 40_000):
        write(tmp_path / f"{n}.xlsx", [["a", "b"], *[[f"inline:text {i} {'x' * 100}", "same"] for i in range(n)]])
        reader = workbooks.Reader(str(tmp_path / f"{n}.xlsx"), ["a", "b"])
        tracemalloc.start()
        assert sum(b.num_rows for b in reader.read(reader.partitions()[0])) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0] + (1 << 20)
