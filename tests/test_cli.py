"""The command line."""

import json

import pytest

from quire.__main__ import main, options, parser
from tests.pdfs import pdf

BODY = [[(50, 780, 18, "F2", "Report"), *[(50, 700 - 14 * i, 10, "F1", f"The words of the text on line {i} are in the page and it is long. " * 2) for i in range(12)]]] * 3


@pytest.mark.parametrize("arguments, status, shown", [(["--help"], 0, "quire"), (["extract", "--help"], 0, "--lang"), (["--version"], 0, "0.1.0"), (["extract", "--out", "x"], 2, "--input"), (["extract", "--input", "x"], 2, "--out"), ([], 2, "command"), (["extract", "--input", "x", "--out", "y", "--tables", "odd"], 2, "invalid choice")])
def test_arguments(capsys, arguments, status, shown):
    with pytest.raises(SystemExit) as e:
        main(arguments)
    out = capsys.readouterr()
    assert e.value.code == status and shown in out.out + out.err


def test_options(spark, tmp_path):
    (tmp_path / "brand.json").write_text(json.dumps({"name": "House", "primary": "#123456", "odd": 1}))
    a = parser().parse_args(["extract", "--input", "i", "--out", "o", "--lang", "es+eng,xx", "--gamma", "--no-deskew", "--brand", str(tmp_path / "brand.json"), "--logo", "l.png", "--tables", "none", "--pages", "2-3", "--recogniser", "tests.pdfs:pdf", "--workers", "3"])
    o = options(spark, a)
    assert o.languages == ("spa", "eng", "xx") and o.export == ("md", "json") and not o.deskew and o.denoise and o.tables is None and o.wanted() == [1, 2] and o.recogniser is pdf
    assert (o.brand.name, o.brand.logo, o.brand.primary) == ("House", "l.png", "#123456")
    with pytest.raises(ValueError, match="no such export: odt"):
        options(spark, parser().parse_args(["extract", "--input", "i", "--out", "o", "--export", "md,odt"]))


def test_extract(spark, tmp_path):
    top, out = tmp_path / "in", tmp_path / "out"
    top.mkdir()
    (top / "a.pdf").write_bytes(pdf(BODY))
    run = lambda *more: main(["extract", "--input", str(top), "--out", str(out), *more])
    (top / "b.pdf").write_bytes(b"junk")
    assert run("--pages", "1,3", "--tables", "none", "--split-mb", "0.001", "--log-file", str(tmp_path / "log")) == 1  # what can be read is written
    assert {p.name for p in out.iterdir() if not p.name.startswith((".", "_"))} == {"a.md", "a.metrics.json"}
    assert json.loads((out / "a.metrics.json").read_text())["total_pages"] == 2 and "b.pdf" in (tmp_path / "log").read_text()
    assert main(["extract", "--input", str(tmp_path / "none"), "--out", str(out)]) == 2
    assert run("--export", "odt") == 2
