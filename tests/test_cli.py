"""Command line: arguments, and one run of every command over the shared session."""

import json
import re

import pytest

from textlens import __main__ as cli


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        ([], cli.Call("color")),
        (["-"], cli.Call("color")),
        (["ir", "a.md"], cli.Call("ir", "a.md")),
        (["--no-color", "--no-color", "a"], cli.Call("color", "a", frozenset({"--no-color"}))),
        (["lint", "--", "-x"], cli.Call("lint", "-x")),
        (["lint", "-h"], cli.Call("help")),
        (["-V"], cli.Call("version")),
    ],
)
def test_arguments(args, expected):
    assert cli.parse(args) == expected


@pytest.mark.parametrize("args", [["--json"], ["ir", "--no-color"], ["a", "b"], ["diagnose", "a"]])
def test_wrong_usage(args):
    with pytest.raises(cli.UsageError):
        cli.parse(args)
    assert cli.main(args) == 2


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark.__class__, "stop", lambda self: None)
    monkeypatch.delenv("NO_COLOR", raising=False)
    file = tmp_path / "a.txt"
    file.write_text("It was very late.\nAn é.", encoding="utf-8")
    assert cli.main(["lint", str(file)]) == 1
    assert capsys.readouterr().out == f"{file}:1:8: info [weak-word]: weak word 'very'\n"
    assert cli.main(["ir", str(file)]) == 0
    assert json.loads(capsys.readouterr().out)["source"]["unitId"] == str(file)
    assert cli.main([str(file)]) == 0
    colored = capsys.readouterr().out
    assert "\x1b[" in colored and re.sub("\x1b\\[[0-9;]*m", "", colored) == file.read_text(encoding="utf-8")
    assert cli.main(["--no-color", str(file)]) == 0
    assert capsys.readouterr().out == file.read_text(encoding="utf-8")
    assert cli.main(["diagnose", "--json", str(file)]) == 0
    assert json.loads(capsys.readouterr().out)["summary"] == {"ansiColoredTokens": 5, "diagnostics": 1, "editorTokens": 3, "highlightedTokens": 3, "tokens": 8}
    marked = tmp_path / "a.md"
    marked.write_text("It is `very` late, really.", encoding="utf-8")
    assert cli.main(["lint", str(marked)]) == 1
    assert capsys.readouterr().out == f"{marked}:1:20: info [weak-word]: weak word 'really'\n"
    file.write_bytes(b"\xff")
    assert cli.main(["lint", str(file)]) == 2
