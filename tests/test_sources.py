"""Folders of files read as tables."""

from quillgraph.sources import files


def test_markdown(spark, tmp_path):
    (tmp_path / "a b+c.md").write_text('---\ntitle: "A: b"\npages: [1, 3]\nkind: plain words\n: none\nnothing\nkind: last\n---\n# Head\n\nBody\n')
    (tmp_path / "bare.md").write_bytes(b"# Only\r\nbody")
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "other.bin").write_bytes(b"\xff")
    got = {r["name"]: r for r in files.markdown(spark, str(tmp_path)).collect()}
    assert set(got) == {"a b+c.md", "bare.md"}  # files of no bytes are left out
    assert {k: v.replace(" ", "") for k, v in got["a b+c.md"]["meta"].items()} == {"title": "A:b", "pages": "[1,3]", "kind": "last"}
    assert got["a b+c.md"]["body"] == "# Head\n\nBody\n"
    assert (got["bare.md"]["meta"], got["bare.md"]["body"]) == ({}, "# Only\nbody")


def test_local_docs_and_sheets(spark, tmp_path):
    (tmp_path / "x.md").write_text("\n \n##\t A title #\nrest")
    (tmp_path / "y.txt").write_bytes(b"\xef\xbb\xbf" + b"z" * 100)
    (tmp_path / "z.txt").write_text(" \n")
    (tmp_path / "s.csv").write_text("a,b\n" * 2000)
    docs = {r["name"]: r["title"] for r in files.local_docs(spark, str(tmp_path)).collect()}
    assert docs == {"x.md": "A title", "y.txt": "z" * 80, "z.txt": "z.txt"}
    got = {r["name"]: (len(r["text"]), r["n_chars"], r["cut"]) for r in files.sheets(spark, str(tmp_path)).collect()}
    assert got == {"s.csv": (6000, 8000, True), "y.txt": (100, 100, False), "z.txt": (2, 2, False)}
