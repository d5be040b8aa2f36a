import json

import pytest

from veilspark.__main__ import main


def test_verbs(spark, tmp_path, capsys):
    pytest.importorskip("yaml")
    (tmp_path / "a.txt").write_text("SONY と sony の a@example.com")
    (tmp_path / "terms.yaml").write_text("Company:\n- canonical: SONY\n  aliases: [ソニー, ｿﾆｰ]\n")
    terms, out = f"{tmp_path}/terms.yaml", f"{tmp_path}/out"
    assert main(["mask", f"{tmp_path}/a.txt", "--dictionary", terms, "--out", out], spark) == 0
    rows = [json.loads(x) for f in (tmp_path / "out" / "masked_parts").glob("*.json") for x in f.read_text().splitlines()]
    assert [r["masked_text"] for r in rows] == ["[社1] と [社2] の [連絡先1]"]
    (tmp_path / "b.txt").write_text("[社2] へ")
    assert main(["unmask", f"{tmp_path}/b.txt", "--mapping", f"{out}/mapping"], spark) == 0
    assert "sony へ" in capsys.readouterr().out
    assert main(["debug", f"{tmp_path}/a.txt", "--dictionary", terms], spark) == 0
    assert "SONY" in capsys.readouterr().out
    assert main(["check", "--dictionary", terms], spark) == 1 and "ｿﾆｰ" in capsys.readouterr().out
