"""Command line: file compress, decompress, verify, extract, extract-show; dir pack, unpack, verify, report."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from lamina.errors import CorruptPayload, HashMismatch, LaminaError, MissingResource, UsageError
from lamina.kernels import codecs, containers, legacy
from lamina.specs import DirectorySpec, FileSpec, stream_codecs


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamina")
    top = p.add_subparsers(dest="area", required=True)
    file = top.add_parser("file").add_subparsers(dest="command", required=True)
    c = file.add_parser("compress", help="layers and codecs may be lists with commas: the smallest result is kept, the first of equal ones")
    c.add_argument("input"), c.add_argument("output")
    c.add_argument("--layer", default="bytes"), c.add_argument("--codec", default="zlib"), c.add_argument("--stream-codecs", default=""), c.add_argument("--pipeline")
    c.add_argument("--version", type=int, choices=range(1, 7), default=6)
    for name in ("decompress", "extract"):
        c = file.add_parser(name)
        c.add_argument("input"), c.add_argument("output")
    c = file.add_parser("verify")
    c.add_argument("input"), c.add_argument("--full", action="store_true"), c.add_argument("--json", action="store_true")
    for name in ("extract-show", "pipeline-validate"):
        file.add_parser(name).add_argument("input")
    d = top.add_parser("dir").add_subparsers(dest="command", required=True)
    c = d.add_parser("pack")
    c.add_argument("input"), c.add_argument("output"), c.add_argument("--buckets", type=int), c.add_argument("--pipeline"), c.add_argument("--memory", help="folder of remembered plans, read and rewritten")
    mode = c.add_mutually_exclusive_group()
    mode.add_argument("--single-container", action="store_true"), mode.add_argument("--mixed-container", action="store_true")
    c = d.add_parser("unpack")
    c.add_argument("input"), c.add_argument("output")
    c = d.add_parser("verify")
    c.add_argument("input"), c.add_argument("--full", action="store_true"), c.add_argument("--json", action="store_true")
    d.add_parser("report").add_argument("input")
    c = d.add_parser("analyze")
    c.add_argument("input"), c.add_argument("output"), c.add_argument("--buckets", type=int, default=16)
    d.add_parser("pipeline-validate").add_argument("input")
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("lamina").getOrCreate()


def envelope(a, kind: str, check) -> None:
    """Run a check; with --json print its outcome in any case."""
    from lamina.workflow import envelope as text

    error = None
    try:
        check()
    except (LaminaError, FileNotFoundError) as e:
        error = str(e)
        raise
    finally:
        if a.json:
            print(text(kind, a.input, a.full, error))


def _file(a) -> None:
    if a.command == "pipeline-validate":
        FileSpec.load(a.input)
    elif a.command == "compress":
        layers, kinds, streams = a.layer.split(","), a.codec.split(","), stream_codecs(a.stream_codecs)
        if a.pipeline:
            plan = FileSpec.load(a.pipeline).plan
            layers, kinds, streams = [plan.layer], [plan.codec], plan.streams
        data = Path(a.input).read_bytes()
        if a.version < 5:
            made = [legacy.write(a.version, data)]
        elif a.version == 5:
            made = [legacy.write_5(data, layer, codec) for layer in layers for codec in kinds]
        else:
            made = [containers.encode(data, layer, codecs.resolve(codec), streams) for layer in layers for codec in kinds]
        Path(a.output).write_bytes(min(made, key=len))
    elif a.command == "decompress":
        Path(a.output).write_bytes(legacy.read(Path(a.input).read_bytes()))
    elif a.command == "extract":
        Path(a.output).write_bytes(containers.extract(Path(a.input).read_bytes()))
    elif a.command == "extract-show":
        nums = containers.extracted(Path(a.input).read_bytes())
        print(len(nums), *nums[:200])
    else:

        def check():
            blob = Path(a.input).read_bytes()
            if a.full or blob[3:4] != bytes([containers.VERSION]):
                legacy.read(blob)
            elif (frame := containers.unframe(blob)).codec == "mbn":
                containers.unbundle(frame.payload)

        envelope(a, "file", check)


def mode_of(spark, folder: str) -> str:
    """bundle or packed, by the header that is there."""
    from lamina.storage import exists

    for name, kind in (("bundle", "bundle"), ("packed", "packed")):
        if exists(spark, f"{folder}/{name}"):
            return kind
    raise CorruptPayload(f"nothing packed in {folder}")


def _dir(a) -> None:
    from lamina import bundles, workflow
    from lamina.sources.files import tree
    from lamina.storage import exists, written

    if a.command == "pipeline-validate":
        DirectorySpec.load(a.input)
        return
    spark = _session()
    if a.command == "pack":
        spec = DirectorySpec.load(a.pipeline, a.buckets) if a.pipeline else DirectorySpec(buckets=a.buckets or 16)
        files = tree(spark, a.input)
        if a.single_container or a.mixed_container:
            bundles.pack(spark, files, a.output, "single" if a.single_container else "mixed")
            return
        history = spark.read.schema("bucket_type string, plan string, layer string, codec string, streams map<string,string>, score double, seen long").json(a.memory) if a.memory and exists(spark, a.memory) else None
        history = None if history is None else written(history)
        workflow.pack(spark, files, a.output, spec, history)
        if a.memory:
            workflow.memory(spark, a.output, history, spec.top_db_max).write.mode("overwrite").json(a.memory)
        print(workflow.write_report(spark, a.output))
    elif a.command == "report":
        print(workflow.write_report(spark, a.input))
    elif a.command == "analyze":
        workflow.analyzed(tree(spark, a.input), a.buckets).select("rel", "size", "simhash64", "is_text", "bucket", "bucket_type").write.mode("overwrite").json(a.output)
    elif a.command == "unpack":
        rows = bundles.unpack(spark, a.input) if mode_of(spark, a.input) == "bundle" else workflow.unpack(spark, a.input)
        restore(rows.select("rel", "content"), a.output)
    else:
        envelope(a, "dir", lambda: _checked(spark, a))


def _checked(spark, a) -> None:
    from lamina import bundles, workflow

    verify = bundles.verify if mode_of(spark, a.input) == "bundle" else workflow.verify
    found = verify(spark, a.input, a.full).orderBy("violation", "rel").limit(200).collect()
    if found:
        kinds = {"corrupt_payload": CorruptPayload, "missing_resource": MissingResource}
        raise kinds.get(found[0].violation, HashMismatch)(f"{len(found)} violations, first: {found[0].rel} {found[0].violation}")


def restore(rows, folder: str) -> None:
    """Write rel, content below a folder that all executors see. Paths that lead out of it, and contents that weren't restored, are refused before anything is written."""
    from lamina.bundles import UNSAFE
    from lamina.sources.archive import write_loose

    bad = rows.filter(rows["rel"].rlike(UNSAFE) | rows["content"].isNull()).select("rel").first()
    if bad:
        raise CorruptPayload(f"not restored: {bad.rel!r}")
    write_loose(rows.withColumnRenamed("content", "blob"), folder).count()


def main(args: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(args)
        (_file if a.area == "file" else _dir)(a)
    except LaminaError as e:
        print(e, file=sys.stderr)
        return e.exit_code
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return UsageError.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
