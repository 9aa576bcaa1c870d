"""Trees packed, checked, tampered with and restored; specifications; the command line; streaming."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lamina import bundles, cli, workflow
from lamina.errors import CorruptPayload, UsageError
from lamina.kernels import containers
from lamina.operators import analyze
from lamina.plans import planner
from lamina.sources import archive, files
from lamina.specs import DirectorySpec, FileSpec, Plan, stream_codecs
from lamina.streaming.ingest import ingest


def make_tree(root):
    made = {"empty.txt": b"", "a/uni code è.txt": "però 😀 — 12\n".encode() * 9, "a/b/random.bin": bytes((k * 197 + k // 7) % 256 for k in range(3000)), "zeros.bin": bytes(2000)}
    made |= {f"inv/{k}.txt": "".join(f"ITEM {j}: qty={j * k} price=1.{j:02d} TOT={j * 7}\n" for j in range(40)).encode() for k in range(8)}
    for rel, data in made.items():
        os.makedirs(os.path.dirname(f"{root}/{rel}") or root, exist_ok=True)
        with open(f"{root}/{rel}", "wb") as f:
            f.write(data)
    return made


def archive_files(out):
    return sorted(os.path.join(d, n) for d, _, names in os.walk(f"{out}/archives") for n in names if n.endswith(".gca"))


def flip(path, at):
    data = bytearray(open(path, "rb").read())
    data[at] ^= 255
    open(path, "wb").write(data)


def test_tree(spark, tmp_path):
    made = make_tree(tmp_path / "in")
    tree = files.tree(spark, str(tmp_path / "in"))
    assert {r.rel: bytes(r.content) for r in tree.collect()} == made
    out = str(tmp_path / "out")
    manifest = workflow.pack(spark, tree, out, DirectorySpec(buckets=3))
    assert manifest.count() == len(made)
    back = workflow.unpack(spark, out)
    assert {r.rel: bytes(r.content) for r in back.collect()} == made
    assert back.filter(F.sha2("content", 256) != F.col("in_sha256")).count() == 0
    assert workflow.verify(spark, out, full=True).count() == 0
    total = workflow.report(manifest).filter("gid = 7").first()
    assert total.files == len(made) and total.in_bytes == sum(map(len, made.values()))
    folder = workflow._folder(spark, out)
    assert workflow.archives(spark, folder, blobs=False).filter("rel = 'zeros.bin'").count() == 1
    text = workflow.write_report(spark, out)
    assert text.startswith(f"files {len(made)}, in {total.in_bytes}") and spark.read.json(f"{out}/report").count() == workflow.report(manifest).count()
    # a file's bytes are damaged: only a full check sees it
    first = workflow.archives(spark, folder, blobs=False).filter("kind is null and length > 30").orderBy("archive", "rel").first()
    name = next(n for n in archive_files(out) if n.endswith(first.archive))
    flip(name, first.offset + first.length // 2)
    assert workflow.verify(spark, out).count() == 0
    assert [(r.rel, r.violation) for r in workflow.verify(spark, out, full=True).collect()] == [(first.rel, "hash_mismatch")]
    # packed again, into the same folder, with fewer files: nothing of the first run comes back
    less = tree.filter("rel like 'inv/%'")
    workflow.pack(spark, less, out, DirectorySpec(buckets=2))
    assert {r.rel for r in workflow.unpack(spark, out).collect()} == {r for r in made if r.startswith("inv/")}
    assert workflow.verify(spark, out, full=True).count() == 0


def test_resources_are_checked(spark, tmp_path):
    rows = [(f"{k}.txt", "".join(f"LINE {j}: n={j * k} of {j}\nKIND {j % 4} has {k}\nEND {j}\nSUM {j} {k}\n" for j in range(60)).encode()) for k in range(6)]
    df, out = spark.createDataFrame(rows, "rel string, content binary"), str(tmp_path / "out")
    workflow.pack(spark, df, out, DirectorySpec(buckets=1, pools={"mixed_text_nums": [Plan("tpl_lines_shared_v0", "zlib")]}))
    summary = workflow.manifest(spark, out).filter("kind = 'bucket_summary'").first()
    assert set(summary.bucket_resources) == {"numbers", "templates"} and workflow.verify(spark, out, full=True).count() == 0
    path = next(f for f in os.listdir(f"{out}/manifest") if f.startswith("part-") and "bucket_summary" in open(f"{out}/manifest/{f}").read())
    text = open(f"{out}/manifest/{path}").read()
    os.remove(f"{out}/manifest/.{path}.crc")
    open(f"{out}/manifest/{path}", "w").write(text.replace('"numbers":"', '"numbers":"0').replace('"templates":', '"other":'))
    assert sorted(r.violation for r in workflow.verify(spark, out).collect()) == ["hash_mismatch", "missing_resource"]


def test_entries_that_cannot_be_right(spark):
    rows = [("a", "x", 0, 10, None), ("a", "y", 10, 5, "0" * 64), ("a", "z", 12, 5, None), ("a", "", 20, 1, None), ("a", "n", -1, 1, None), ("a", "h", 30, 1, "zz"), ("b", "x", 5, 0, None)]
    index = spark.createDataFrame(rows, "archive string, rel string, offset long, length long, blob_sha256 string")
    assert sorted(r.rel for r in archive.entry_violations(index).collect()) == ["", "h", "n", "z"]


def test_loose_files(spark, tmp_path):
    made = make_tree(tmp_path / "in")
    out = str(tmp_path / "out")
    manifest = workflow.pack(spark, files.tree(spark, str(tmp_path / "in")), out, DirectorySpec(buckets=2, archive=False))
    assert manifest.filter("archive is not null").count() == 0 and not os.path.exists(f"{out}/archives")
    assert {r.rel: bytes(r.content) for r in workflow.unpack(spark, out).collect()} == made
    assert workflow.verify(spark, out, full=True).count() == 0
    os.remove(f"{workflow._folder(spark, out)}/zeros.bin.gcc6")
    assert [r.rel for r in workflow.verify(spark, out).collect()] == ["zeros.bin"]


def test_autopick(spark, tmp_path):
    words = "bolt nut screw washer hinge bracket hook clamp".split()
    rows = [(f"{k}.txt", "".join(f"ITEM {words[j % 8]} size {j}: qty={j * k} price=1.{j:02d} TOT={j * 7} of the {words[j % 8]} stock\n" for j in range(40)).encode()) for k in range(24)]
    df, out = spark.createDataFrame(rows, "rel string, content binary"), str(tmp_path / "out")
    workflow.pack(spark, df, out, DirectorySpec(buckets=1, refresh_top=True))
    best = spark.read.json(f"{out}/trials").orderBy("pos").collect()
    summary = workflow.manifest(spark, out).filter("kind = 'bucket_summary'").first()
    assert len(best) == 7 and summary.plan == best[0].plan and not summary.runner_up.startswith(f"{best[0].layer}:")
    workflow.pack(spark, df, out, DirectorySpec(buckets=1))  # the two to begin with: shared templates pay
    summary = workflow.manifest(spark, out).filter("kind = 'bucket_summary'").first()
    assert summary.bucket_type == "mixed_text_nums" and summary.layer_id == "tpl_lines_shared_v0" and summary.runner_up.startswith("tpl_lines_v0:")
    history = spark.createDataFrame(workflow.memory(spark, out).collect(), "bucket_type string, plan string, layer string, codec string, streams map<string,string>, score double, seen long")
    assert history.count() == 1 and history.first().plan == summary.plan
    again = workflow.memory(spark, out, history)
    assert again.first().seen == 2
    more = history.unionByName(spark.createDataFrame([("mixed_text_nums", "bytes:zlib", "bytes", "zlib", {}, 0.9, 1), ("mixed_text_nums", "tpl_lines_shared_v0:zlib", "tpl_lines_shared_v0", "zlib", {}, 0.8, 1)], history.schema))
    known = planner.table(spark, DirectorySpec(), more).filter("bucket_type = 'mixed_text_nums'")
    assert {r.plan for r in known.collect()} == {summary.plan, "bytes:zlib"}
    assert planner.table(spark, DirectorySpec(autopick=False)).groupBy("bucket_type").count().filter("count > 1").count() == 0


def test_fingerprint_branches(spark):
    rng = random.Random(1)
    noise = bytes(rng.randrange(1, 256) for _ in range(60_000))
    made = {"empty": b"", "words": b"some words here, some more", "marks": b"- -\n+ +\n", "stars": b"* *\n% %\n", "noise": noise, "spaces": b"  \n \n"}
    df = spark.createDataFrame(list(made.items()), "rel string, content binary")
    got = {r.rel: r for r in analyze.fingerprints(df, "rel", "content").collect()}
    full = (1 << 64) - 1

    def votes(parts):
        n = [0] * 64
        for data, w in parts:
            h = int.from_bytes(hashlib.md5(data).digest()[:8], "big")
            for k in range(64):
                n[k] += w if h >> k & 1 else -w
        return sum(1 << k for k in range(64) if n[k] >= 0)

    want = {"empty": ("empty", 0), "words": ("tokens", votes([(b"some", 2), (b"words", 1), (b"here", 1), (b"more", 1)])), "marks": ("lines", votes([(b"- -", 1), (b"+ +", 1)])), "stars": ("lines", votes([(b"* *", 1), (b"% %", 1)])), "spaces": ("lines", full), "noise": ("bin4", votes([(noise[k : k + 4], 1) for k in range(0, 60_000, 4)]))}
    assert {k: (r.branch, int(r.simhash64)) for k, r in got.items()} == want
    own = workflow.analyzed(df, 8, lambda simhash, n: F.when(F.col("rel") == "noise", F.lit(n + 3)))
    assert own.filter("bucket = 11").count() == 1 and own.filter("bucket < 8").count() == 5
    placed = workflow.analyzed(df, 1 << 20)
    assert placed.filter("rel = 'noise'").first().bucket_type == "binaryish"


@pytest.mark.parametrize("mode", ["single", "mixed"])
def test_bundles(spark, tmp_path, mode):
    made = make_tree(tmp_path / "in")
    out, block = str(tmp_path / "out"), 1500
    tree = files.tree(spark, str(tmp_path / "in"))
    if mode == "single":
        with pytest.raises(UsageError):
            bundles.pack(spark, tree, out, mode, block)
        made = {k: v for k, v in made.items() if k != "a/b/random.bin"}
        tree = tree.filter("rel <> 'a/b/random.bin'")
    index = bundles.pack(spark, tree, out, mode, block).orderBy("kind", "rel").collect()
    at = {}
    for r in index:
        assert (r.offset, r.length) == (at.get(r.kind, 0), len(made[r.rel])) and r.sha256 == hashlib.sha256(made[r.rel]).hexdigest()
        at[r.kind] = r.offset + r.length
    assert set(at) == ({"text"} if mode == "single" else {"text", "bin"})
    assert {r.rel: bytes(r.content) for r in bundles.unpack(spark, out).collect()} == made
    one = bundles.unpack(spark, out, bundles.lookup(spark, out, "inv/3.txt")).collect()
    assert [bytes(r.content) for r in one] == [made["inv/3.txt"]]
    assert bundles.verify(spark, out, full=True).count() == 0
    blocks = spark.read.parquet(f"{out}/blocks").orderBy("kind", "block").collect()
    hurt = lambda b: b[: len(b) // 2] + bytes([b[len(b) // 2] ^ 255]) + b[len(b) // 2 + 1 :]
    damaged = [(r.kind, r.block, r.length, r.sha256, hurt(bytes(r.blob)) if k == 1 else bytes(r.blob)) for k, r in enumerate(blocks)]
    spark.createDataFrame(damaged, bundles.BLOCKS).write.mode("overwrite").parquet(f"{out}/blocks")
    assert bundles.verify(spark, out).count() == 1 and bundles.verify(spark, out, full=True).filter("violation = 'hash_mismatch'").count() > 1
    spark.createDataFrame(damaged[1:], bundles.BLOCKS).write.mode("overwrite").parquet(f"{out}/blocks")
    assert "corrupt_payload" in {r.violation for r in bundles.verify(spark, out).collect()}


def test_specs():
    doc = {"spec": "x.pipeline.v1", "name": "n", "layer": "split_text_nums", "codec": "zlib", "stream_codecs": {"TEXT": "zlib", "11": "num_v1"}}
    assert FileSpec.load(json.dumps(doc)).plan.streams == {"TEXT": "zlib", "NUMS": "num_v1"}
    assert stream_codecs("text:zlib;NUMS:num_v1") == {"TEXT": "zlib", "NUMS": "num_v1"}
    for bad in ({**doc, "other": 1}, {**doc, "layer": "no"}, {k: v for k, v in doc.items() if k != "name"}, []):
        with pytest.raises(UsageError):
            FileSpec.load(json.dumps(bad))
    spec = DirectorySpec.load({"spec": "x.dir_pipeline.v1", "buckets": 4, "autopick": {"sample_n": 3}, "resources": {"num_dict_v1": {"enabled": False}}, "candidate_pools": {"textish": [{"layer": "bytes", "codec": "zlib"}]}}, buckets=9)
    assert (spec.buckets, spec.sample_n, spec.numbers_k, len(spec.pools["textish"])) == (9, 3, 0, 1)
    more = DirectorySpec.load({"spec": "x.dir_pipeline.v1", "archive": False, "autopick": {"enabled": False, "top_k": 1, "top_db_max": 3, "refresh_top": True}})
    assert (more.archive, more.autopick, more.top_k, more.top_db_max, more.refresh_top) == (False, False, 1, 3, True)
    with pytest.raises(UsageError):
        FileSpec.load({**doc, "mbn": False})
    for bad in ({"archive": 1}, {"autopick": {"top_k": 0}}, {"autopick": {"enabled": "yes"}}, {"autopick": {"sample_n": 9}}, {"extra": 1}, {"candidate_pools": {"no": []}}):
        with pytest.raises(UsageError):
            DirectorySpec.load({"spec": "x.dir_pipeline.v1", **bad})


def test_command_line(tmp_path, capsys):
    src, packed, back = (str(tmp_path / n) for n in ("a", "b", "c"))
    open(src, "wb").write(b"x 12 y -7\n" * 30)
    assert cli.main(["file", "compress", src, packed, "--layer", "tpl_lines_v0", "--stream-codecs", "TPL:raw"]) == 0
    assert cli.main(["file", "verify", packed]) == 0 and cli.main(["file", "decompress", packed, back]) == 0
    assert open(back, "rb").read() == open(src, "rb").read()
    open(packed, "ab").write(b"z")
    assert cli.main(["file", "verify", packed]) == 10 and cli.main(["file", "verify", src + "none"]) == 2
    assert cli.main(["file", "extract", src, packed]) == 0 and cli.main(["file", "extract-show", packed]) == 0
    assert capsys.readouterr().out.startswith("60 12 -7")
    open(src, "wb").write(b"1 1234567890123456789 -22 " + b"9" * 40)
    assert cli.main(["file", "extract", src, packed]) == 0 and cli.main(["file", "extract-show", packed]) == 0 and cli.main(["file", "decompress", packed, back]) == 2
    assert capsys.readouterr().out.split() == ["4", "1", "1234567890123456789", "-22", "9" * 40]
    for version in range(1, 7):
        assert cli.main(["file", "compress", src, packed, "--version", str(version), "--codec", "huffman" if version == 5 else "zlib"]) == 0
        assert open(packed, "rb").read()[3] == version and cli.main(["file", "verify", "--full", packed]) == 0
        assert cli.main(["file", "decompress", packed, back]) == 0 and open(back, "rb").read() == open(src, "rb").read()
    assert cli.main(["file", "compress", src, packed, "--layer", "lines_dict,bytes", "--codec", "zlib,raw"]) == 0
    sizes = [len(containers.encode(open(src, "rb").read(), layer, codec)) for layer in ("lines_dict", "bytes") for codec in ("zlib", "raw")]
    assert os.path.getsize(packed) == min(sizes)
    capsys.readouterr()
    flip(packed, 9)
    code = cli.main(["file", "verify", "--full", "--json", packed])
    said = json.loads(capsys.readouterr().out)
    assert code in (2, 10, 11) and said["ok"] is False and said["kind"] == "file" and said["full"] is True


def test_directories_on_the_command_line(spark, tmp_path, capsys):
    made = make_tree(tmp_path / "in")
    for k, flags in enumerate((["--buckets", "2"], ["--mixed-container"], ["--memory", str(tmp_path / "memory")])):
        out, back = str(tmp_path / f"out{k}"), tmp_path / f"back{k}"
        assert cli.main(["dir", "pack", str(tmp_path / "in"), out, *flags]) == 0
        assert cli.main(["dir", "verify", "--full", "--json", out]) == 0 and cli.main(["dir", "unpack", out, str(back)]) == 0
        assert {str(p.relative_to(back)): p.read_bytes() for p in back.rglob("*") if p.is_file()} == made
    assert (tmp_path / "memory").exists()
    assert cli.main(["dir", "verify", str(tmp_path / "in")]) == 10
    with pytest.raises(CorruptPayload):
        cli.restore(spark.createDataFrame([("../x", b"1")], "rel string, content binary"), str(tmp_path / "r"))
    assert not (tmp_path / "r").exists() and not (tmp_path / "x").exists()


def test_json_lines(spark, tmp_path):
    (tmp_path / "m").write_text('{"kind":"bucket_summary","bucket":1}\n\n{bad\n[1]\n{"rel":"a","in_size":3}\n{"rel":"b","error":"x"}\n')
    m = files.json_lines(spark, str(tmp_path / "m"))
    assert m.count() == 3 and files.file_records(m).count() == 1 and files.bucket_summaries(m).count() == 1


def test_streaming(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, "some words here"), (k + 10, "")], "doc_id long, text string").write.parquet(str(tmp_path / f"in/{k}"))
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 4).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == 4 and rows.filter("doc_id < 10").select("simhash64").distinct().count() == 1


def test_import_direction():
    """Nothing but the entry and the pipeline imports the llm subpackage; kernels import no Spark but in arrow.py."""
    root = os.path.dirname(os.path.dirname(workflow.__file__))
    for d, _, names in os.walk(f"{root}/lamina"):
        for n in names:
            if n.endswith(".py") and not d.endswith("llm"):
                text = open(f"{d}/{n}").read()
                assert "lamina.llm" not in text, n
                assert not (d.endswith("kernels") and n != "arrow.py" and "pyspark" in text), n


def test_files_are_not_dealt_by_bucket(spark, tmp_path, monkeypatch):
    """Coding and decoding don't gather a bucket's files: no shuffle by bucket or archive is left when files meet their dictionaries."""
    from pyspark.sql import functions as F

    from lamina import workflow

    seen, real = [], workflow.written
    monkeypatch.setattr(workflow, "written", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that Spark takes to be large
    try:
        files = spark.range(40).select(F.concat(F.lit("f/"), F.col("id").cast("string")).alias("rel"), F.encode(F.expr("repeat(concat('line ', id, '\n'), 20)"), "UTF-8").alias("content"))
        workflow.pack(spark, files, f"file://{tmp_path}/out")
        plan = workflow.unpack(spark, f"file://{tmp_path}/out")
        text = plan._jdf.queryExecution().executedPlan().toString()
        coded = seen[-1]
        assert "SortMergeJoin [bucket" not in coded and "SortMergeJoin [archive" not in text
        assert plan.filter("sha2(content, 256) = in_sha256").count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
