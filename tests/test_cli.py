import io
import os

import pytest

from scriptorium import cli

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")


def test_arguments():
    assert cli.parse(["--data", "d", "--question", "q"]).mode == "hybrid"
    for bad in (["--data", "d", "--top-k", "0"], ["--data", "d", "--mode", "x"], ["--data", "d", "--build"], []):
        with pytest.raises(SystemExit):
            cli.parse(bad)


def test_build_and_ask(spark, sf, tmp_path):
    path = str(tmp_path / "index")
    assert "indexed" in cli.main(["--data", sf, "--index", path, "--build"], spark)
    text = spark.read.parquet(f"{sf}/chunks.parquet").filter("length(text) > 60 AND source = 'curated'").orderBy("pos").first().text[:80]
    for mode in cli.MODES:
        out = cli.main(["--data", sf, "--index", path, "--question", text, "--mode", mode, "--no-llm", "--debug"], spark)
        assert "[S1]" in out and "mode retrieval-only" in out and "reachable" not in out
    out = cli.main(["--data", sf, "--index", path, "--top-k", "2"], spark, lines=io.StringIO(f"{text}\n\n"))
    assert "is not reachable" in out and "[S2]" in out
    meta = spark.read.parquet(f"{path}/meta").first().asDict()
    spark.createDataFrame([{**meta, "fingerprint": "other"}]).write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError):
        cli.main(["--data", sf, "--index", path, "--question", text], spark)
