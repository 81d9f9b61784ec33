import json

import pytest

from quire import log
from quire.sources import files


def test_copy_and_folders(tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 3_000_000)
    files.copy_file(str(tmp_path / "a.bin"), str(tmp_path / "new/deep/b.bin"))
    files.copy_file(f"file://{tmp_path}/a.bin", str(tmp_path / "new/deep/b.bin"))  # over the first
    assert (tmp_path / "new/deep/b.bin").read_bytes() == b"x" * 3_000_000
    with pytest.raises(FileNotFoundError):
        files.copy_file(str(tmp_path / "none"), str(tmp_path / "c"))
    with pytest.raises(FileNotFoundError):
        files.copy_file(str(tmp_path), str(tmp_path / "c"))
    assert files.ensure_folder(files.ensure_folder(str(tmp_path / "p/q"))) and (tmp_path / "p/q").is_dir()


def test_messages(tmp_path, capsys):
    to = str(tmp_path / "m.log")
    log.configure("warning", True, to).info("unheard")
    log.configure("info", True, to).info("wrote %d files", 3)
    log.configure("info").warning("plain")
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 2 and json.loads(out[0])["message"] == "wrote 3 files" and out[1].endswith("WARNING quire: plain")
    assert [json.loads(x)["level"] for x in open(to)] == ["info"]
    with pytest.raises(ValueError):
        log.configure("loud")
