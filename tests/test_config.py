import pytest

from spanrank.__main__ import main, parser
from spanrank.plans import config


def test_precedence_and_files(tmp_path):
    home, inner = str(tmp_path / "home"), tmp_path / "p" / "q"
    inner.mkdir(parents=True)
    config.write(str(inner), "max_chars", 1, home=home)
    config.write(str(inner), "api_key", "k", home=home)
    assert config.load(str(inner), {}, {}, home)[0].max_chars == 1
    config.write(str(tmp_path / "p"), "max_chars", 2, project=True)
    assert config.load(str(inner), {}, {}, home)[0].max_chars == 2
    assert config.load(str(inner), {}, {"SPANRANK_MAX_CHARS": "3", "SPANRANK_CODE": "on"}, home)[0].max_chars == 3
    settings, rest = config.load(str(inner), {"max_chars": 4}, {"SPANRANK_MAX_CHARS": "3"}, home)
    assert settings.max_chars == 4 and rest["api_key"] == "k"
    with pytest.raises(ValueError):
        config.write(str(inner), "api_key", "k", project=True)
    with pytest.raises(ValueError):
        config.write(str(inner), "nonsense", 1, home=home)


def test_commands(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("---\nstatus: live\n---\n# Cats\ncats purr\n")
    place = str(tmp_path / "i")
    assert main(["index", str(docs), place]) == 0
    assert main(["query", place, "cats", "--where", "status=live"]) == 0
    assert "a.md:4-5  Cats" in capsys.readouterr().out
    assert main(["query", place, "cats", "--where", "status=dead"]) == 0
    assert "no record meets status=dead" in capsys.readouterr().out
    assert main(["status", place]) == 0
    assert "keys: status" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        parser().parse_args(["unknown"])
