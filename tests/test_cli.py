from __future__ import annotations

import json

from doclathe.cli import main


def test_verbs(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("Title\nmail a@b.org about Python")
    (tmp_path / "d/b.html").write_text("<title>t</title><p>Page text</p>")
    (tmp_path / "r.json").write_text('[{"title": "x", "score": 0.3}, {"title": ""}]')
    said = lambda *a: (main([*map(str, a)]), capsys.readouterr().out.strip().split("\n"))[1]
    out = said("pipeline", tmp_path / "d")
    assert json.loads(out[-1])["total"] == 2 and json.loads(out[0])["content_type"] == "document"
    assert len(said("parse", tmp_path / "d")) == 2
    assert "content_md5" in said("extract", tmp_path / "d")[0]
    assert "fenced" not in said("extract", tmp_path / "d", "--provider", "echo")[0]
    out = json.loads(said("validate", tmp_path / "r.json", "--required", "title")[-1])
    assert (out["total"], out["passed"], out["needs_recheck"]) == (2, 1, 1)
    out = json.loads(said("batch", tmp_path / "d", "--state", tmp_path / "s", "--shard-size", 1, "-o", tmp_path / "o")[-1])
    assert out["status"] == "completed" and out["processed"] == 2
    assert json.loads(said("status", tmp_path / "s", out["batch_id"])[-1])["completed"] == 2
    assert json.loads(said("batch", tmp_path / "d", "--state", tmp_path / "s", "--resume", out["batch_id"])[-1])["processed"] == 2
    assert len(said("plugins")) >= 8
