import json

import pytest

from lodestock.cli import main


def run(capsys, *argv):
    code = main([str(a) for a in argv])
    out = capsys.readouterr()
    return code, out.out, out.err


def test_commands(spark, capsys, tmp_path):
    image = tmp_path / "sample.jpg"
    image.write_bytes(b"sample-image")
    root = tmp_path / "ws"
    digest = "c9da6ac892c00c4a7b8ac147474e39e222d504916a215f69089da97e27386b9d"
    for _ in range(2):
        assert run(capsys, "init", root) == (0, f"Initialized dataset workspace: {root}\n", "")
    assert run(capsys, "add", root, image, "--label", "a", "--lab", "katze é") == (0, f"added: {digest}\n", "")
    assert run(capsys, "add", root, image)[1] == f"already present: {digest}\n"
    summary = '{"bytes": 12, "items": 1, "labels": {"katze é": 1}}\n'
    assert run(capsys, "summary", root) == (0, summary, "")
    code, out, _ = run(capsys, "demo", "--workspace", root)
    assert (code, out.count("\n"), out.endswith(summary)) == (0, 4, True)
    assert run(capsys, "add", root, image, image)[1] == f"already present: {digest}\n" * 2


def test_demo_writes_nothing(spark, capsys, tmp_path):
    code, out, _ = run(capsys, "demo", "--workspace", tmp_path / "none")
    assert code == 0 and json.loads(out.splitlines()[-1]) == {"bytes": 0, "items": 0, "labels": {}}
    assert not (tmp_path / "none").exists()


def test_errors(spark, capsys, tmp_path):
    code, _, err = run(capsys, "add", tmp_path / "w", tmp_path / "missing")
    assert code == 1 and "FileNotFoundError" in err
    for wrong in ([], ["nonsense"], ["add", "w"]):
        with pytest.raises(SystemExit) as e:
            main(wrong)
        assert e.value.code == 2
