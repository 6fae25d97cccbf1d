import json

import pytest


@pytest.mark.parametrize("tail", [b"", b"\n", b"\n\n"])
@pytest.mark.parametrize("mark", [b"", b"\xef\xbb\xbf"])
def test_large_files_are_read_by_line(spark, tmp_path, monkeypatch, tail, mark):
    """a large text file's document comes in pieces that make the whole; value-a-line JSON is rejected by its lines."""
    from fablake.sources import normalise as nz

    monkeypatch.setattr(nz, "WHOLE_BYTES", 100)
    text = mark + "\n".join(f'line {i} "é"\t\\ \r' for i in range(50)).encode() + tail
    (tmp_path / "a.txt").write_bytes(text)
    (tmp_path / "bad.txt").write_bytes(b"x\n" * 100 + b"\xff\n")
    (tmp_path / "rows.json").write_bytes(b'\n{"a": 1}\n' * 40)
    (tmp_path / "one.json").write_bytes(b'{"a": [\n' + b"1,\n" * 60 + b"2]}\n")
    (tmp_path / "bad.json").write_bytes(b'{"a": 1}\n' * 40 + b"\xff\n")
    (tmp_path / "small.csv").write_bytes(b"a,b\n1,2\n")
    docs = nz.normalise_folder(spark, str(tmp_path), "out")
    rows = docs.collect()
    by_name = {}
    for r in sorted(rows, key=lambda r: (r.rel_path, r.block, r.line)):
        by_name.setdefault(r.rel_path.strip("/"), []).append(r)
    assert len(by_name["a.txt"]) > 1
    assert json.loads("".join(r.doc for r in by_name["a.txt"])) == {"text": text.decode()}
    assert [(r.doc, r.reject) for r in by_name["bad.txt"]] == [(None, "not valid UTF-8 text")]
    assert [(r.doc, r.reject) for r in by_name["rows.json"]] == [(None, "not valid JSON")]
    assert [(r.doc, r.reject) for r in by_name["bad.json"]] == [(None, "not valid UTF-8")]
    assert len(json.loads(by_name["one.json"][0].doc)["a"]) == 61
    assert json.loads(by_name["small.csv"][0].doc)["row_count"] == 1
    assert nz.summary(docs).first().asDict() == {"written": 3, "rejected": 3}
