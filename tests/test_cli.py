import io
import json

from quillflow import cli


def test_init_run_ls_inspect(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init"]) == 0
    (tmp_path / "input.jsonl").write_text('{"item": "A"}\n')
    text = (tmp_path / "pipeline.py").read_text().replace("./input.jsonl", f"{tmp_path}/input.jsonl").replace("./output", f"{tmp_path}/output")
    (tmp_path / "pipeline.py").write_text(text)
    cli.main(["init"])  # keeps what is there
    assert (tmp_path / "pipeline.py").read_text() == text
    cli.main(["run", "pipeline.py"])
    run = capsys.readouterr().out.split()[-1]
    assert json.loads(spark.read.text(str(tmp_path / "output")).first().value)["item"] == "a"
    cli.main(["ls", "runs"])
    assert run in capsys.readouterr().out
    cli.main(["inspect", run])
    assert "[done]" in capsys.readouterr().out
    cli.main(["resume", run, "pipeline.py"])
    (tmp_path / "t.py").write_text("from pyspark.sql import functions as F\nfrom quillflow.operators import ColumnTool\nup = ColumnTool('up', '1', F.upper)\n")
    monkeypatch.setattr("sys.stdin", io.StringIO('"x"'))
    cli.main(["tool", "t.py", "up"])
    assert '"X"' in capsys.readouterr().out
