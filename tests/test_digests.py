import hashlib
import os
import resource

from pyspark.sql import functions as F

from tileweave.operators.images import score_images
from tileweave.session import spread
from tileweave.sources import datasource, digests


def test_digests_of_files(spark, tmp_path):
    contents = {"a": b"", "b": b"x" * 10, "c": os.urandom(3 * digests.CHUNK + 7)}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    listed = datasource.scan_headers(spark, str(tmp_path)).select("path", "length")
    rows = {os.path.basename(r.path): r for r in digests.with_sha256(listed).collect()}
    assert {n: (rows[n].sha256, rows[n].n_hashed) for n in contents} == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in contents.items()}
    trees = {os.path.basename(r.path): (r.tree_sha256, r.n_parts) for r in digests.tree_digests(listed, part=1_000_000).collect()}
    for name, content in contents.items():
        parts = [content[i : i + 1_000_000] for i in range(0, max(len(content), 1), 1_000_000)]
        assert trees[name] == (hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest(), len(parts))
    odd = spark.createDataFrame([(str(tmp_path / "none"), 5), (None, None), (str(tmp_path / "b"), 99)], "path string, length bigint")
    by = {os.path.basename(r.path or "null"): r for r in digests.with_sha256(odd).collect()}
    assert by["none"].hash_error.startswith("io: ") and by["none"].sha256 is None and by["null"].hash_error is None
    assert {r.tree_sha256 for r in digests.tree_digests(odd.filter("path IS NOT NULL")).collect()} == {None}


def test_a_file_larger_than_a_row(tmp_path):
    path = str(tmp_path / "sparse")
    with open(path, "wb") as out:
        out.truncate(3 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    digest, size = digests._fold(path)
    assert size == 3 << 30 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100 * 1024
    want = hashlib.sha256()
    for _ in range(3 << 10):
        want.update(bytes(1 << 20))
    assert digest == want.hexdigest()


def test_workers_keep_their_session(spark, tmp_path):
    log = str(tmp_path / "log")

    def open_session():
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return os.getpid()

    def score(session, batch):
        return batch.assign(pid=session, same=session == os.getpid())[["id", "pid", "same"]]

    rows = score_images(spread(spark.range(6400), 64), open_session, score, "id bigint, pid bigint, same boolean")
    found = rows.agg(F.count("*").alias("n"), F.min("same").alias("same"), F.count_distinct("pid").alias("workers")).first()
    with open(log) as lines:
        opened = lines.read().split()
    assert (found.n, found.same) == (6400, True) and len(opened) == len(set(opened)) <= 8
    # Another job opens its own; the worker lets go of the old one.
    again = score_images(spark.range(4), open_session, score, "id bigint, pid bigint, same boolean")
    assert again.count() == 4
    with open(log) as lines:
        assert len(lines.read().split()) > len(opened)
