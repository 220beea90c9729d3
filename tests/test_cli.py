"""The command line, signatures and counters."""

import io
import json
import random
import string
import tarfile

from pyspark.sql import functions as F

from driftnet.__main__ import main
from driftnet.functions import signing
from driftnet.operators import report
from driftnet.sources import files

TOKEN = "glpat" + "-" + "".join(random.Random(1).choices(string.ascii_letters, k=20))


def test_scan_and_exit_codes(spark, tmp_path, capsys):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / ".env").write_text(f"X={TOKEN}\n")
    (tmp_path / "a" / "b.txt").write_text("nothing\n")
    where = str(tmp_path / "a")
    assert main(["scan", where], spark) == 1
    shown = capsys.readouterr().out
    assert "gitlab.token" in shown and TOKEN not in shown
    assert main(["scan", where, "--exclude-rules", "gitlab", "--no-keyname", "--no-entropy"], spark) == 0
    assert main(["scan", where, "-f", "sarif"], spark) == 2
    assert main(["scan", where, "-f", "json", "-o", str(tmp_path / "out")], spark) == 1
    assert TOKEN not in "".join(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert main(["rules"], spark) == 0 and "github.token" in capsys.readouterr().out
    assert main(["classify", "x/.env", "a.png"], spark) == 0
    assert "skipped" in capsys.readouterr().out


def test_image(spark, tmp_path, capsys):
    layer, image = io.BytesIO(), io.BytesIO()
    for box, name, body in ((layer, "etc/app.conf", f"t = {TOKEN}\n".encode()), (image, "abc/layer.tar", None)):
        with tarfile.open(fileobj=box, mode="w") as tar:
            body = body if body is not None else layer.getvalue()
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    (tmp_path / "app.tar").write_bytes(image.getvalue())
    assert main(["scan", str(tmp_path / "app.tar"), "--as", "image", "--no-entropy", "--no-keyname"], spark) == 1
    assert "app!/" in capsys.readouterr().out


def test_signature():
    # The worked example of the public documentation (its key is no real one).
    key = signing.signing_key("wJalrXUtnFEMI/K7MDENG+" + "bPxRfiCYEXAMPLEKEY", "20150830", "us-east-1", "iam")
    assert key.hex() == "c4afb1cc5771d871763a393e44b703571b55cc28424d1a5e86da6ed3c154a4b9"
    made = signing.authorization("ID", "secret", "POST", "h.example", "/", "a=b", "20260101T000000Z", "r", "s")
    assert made.startswith("AWS4-HMAC-SHA256 Credential=ID/20260101/r/s/aws4_request, SignedHeaders=host;x-amz-date, Signature=") and len(made.rsplit("=", 1)[1]) == 64


def test_pairs_and_stats(spark):
    a, b = signing.split_pair(F.col("p"))
    assert [tuple(r) for r in spark.createDataFrame([("i:s:t",), ("x",)], "p string").select(a, b).collect()] == [("i", "s:t"), (None, None)]
    leaves = files.unpacked(spark.createDataFrame([("a", bytearray(b"xyz")), ("b.zip", bytearray(b"PK\x03\x04broken"))], "path string, content binary"))
    row = report.scan_stats(leaves, spark.range(3)).first().asDict()
    assert row == {"files": 2, "blobs": 1, "bytes": 3, "errors": 1, "findings": 3}


def test_public_names():
    import driftnet

    assert driftnet.ScanOptions().min_severity == "low" and callable(driftnet.scan) and len(driftnet.BUILT_IN) == 36


def test_incremental_scans(spark, tmp_path, capsys):
    import os

    where, db, out = tmp_path / "t", str(tmp_path / "db"), str(tmp_path / "out")
    where.mkdir()
    other = "glpat" + "-" + "".join(random.Random(2).choices(string.ascii_letters, k=20))
    (where / "a.txt").write_text(f"X={TOKEN}\n")
    (where / "b.txt").write_text("nothing\n")
    run = ["scan", str(where), "--db", db, "--no-entropy", "--no-keyname", "-f", "json"]

    def report_of(name, *more):
        main([*run, "-o", f"{out}/{name}", *more], spark)
        return [json.loads(r[0]) for r in spark.read.text(f"{out}/{name}").collect()]

    first = report_of("1")
    assert [(r["is_new"], r["carried"]) for r in first if r["rule_id"] == "gitlab.token"] == [(True, False)]
    again = report_of("2")
    assert [(r["is_new"], r["carried"]) for r in again if r["rule_id"] == "gitlab.token"] == [(False, True)]
    (where / "b.txt").write_text(f"Y={other}\n")
    os.utime(where / "b.txt", (2e9, 2e9))
    assert {os.path.basename(r["source_path"]) for r in report_of("3", "--new-only")} == {"b.txt"}
    (where / "a.txt").unlink()
    assert {os.path.basename(r["source_path"]) for r in report_of("4")} == {"b.txt"}
    assert main(["scan", str(where), "--new-only"], spark) == 2
    # Nothing under the state folder holds a value in clear.
    for folder, _, names in os.walk(db):
        for name in names:
            with open(os.path.join(folder, name), "rb") as file:
                body = file.read()
            assert TOKEN.encode() not in body and other.encode() not in body


def test_errors_are_shown(spark, tmp_path, capsys):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.zip").write_bytes(b"PK\x03\x04broken")
    assert main(["scan", str(tmp_path / "e")], spark) == 0
    assert "not read: zip" in capsys.readouterr().err
