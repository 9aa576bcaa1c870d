"""Pipeline specifications: JSON documents, checked strictly."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from lamina.errors import UsageError
from lamina.kernels.containers import CODECS, LAYERS, STREAMS

TYPES = ("binaryish", "mixed_text_nums", "textish")


def stream_codecs(text: str) -> dict[str, str]:
    """TEXT:zlib,NUMS:num_v1 (or with semicolons; a stream's number for its name) as a mapping."""
    names, out = {str(v): k for k, v in STREAMS.items()}, {}
    for part in text.replace(";", ",").split(","):
        if not part.strip():
            continue
        stream, colon, codec = (x.strip() for x in part.partition(":"))
        stream = names.get(stream, stream.upper())
        if not colon or stream not in STREAMS or codec not in CODECS:
            raise UsageError(f"not stream:codec: {part!r}")
        out[stream] = codec
    return out


def _document(text: str | dict) -> dict:
    if isinstance(text, dict):
        return text
    raw = Path(text[1:]).read_text() if text.startswith("@") else text
    try:
        doc = json.loads(raw)
    except ValueError as e:
        raise UsageError(f"not JSON: {e}") from e
    if not isinstance(doc, dict):
        raise UsageError("a specification is an object")
    return doc


def _only(doc: dict, allowed: set[str], where: str) -> None:
    if extra := set(doc) - allowed:
        raise UsageError(f"{where} has no {', '.join(sorted(extra))}")


def _checked_codecs(value) -> dict[str, str] | None:
    if value is None:
        return None
    if not isinstance(value, dict):
        raise UsageError("stream_codecs is an object")
    return stream_codecs(",".join(f"{k}:{v}" for k, v in value.items()))


@dataclass(frozen=True)
class Plan:
    layer: str
    codec: str
    streams: dict[str, str] | None = None
    note: str = ""

    def __post_init__(self):
        if self.layer not in LAYERS or self.codec not in CODECS or self.codec in ("mbn", "num_v0", "num_v1"):
            raise UsageError(f"no plan of layer {self.layer!r} and codec {self.codec!r}")

    @property
    def key(self) -> str:
        return ":".join([self.layer, self.codec, *(f"{k}={v}" for k, v in sorted((self.streams or {}).items()))])


@dataclass(frozen=True)
class FileSpec:
    name: str
    plan: Plan

    @classmethod
    def load(cls, text: str | dict) -> FileSpec:
        doc = _document(text)
        _only(doc, {"spec", "name", "layer", "codec", "stream_codecs", "mbn"}, "a file pipeline")
        if not str(doc.get("spec", "")).endswith("pipeline.v1") or not all(isinstance(doc.get(k), str) for k in ("name", "layer", "codec")):
            raise UsageError("a file pipeline has spec, name, layer and codec")
        if doc.get("mbn", True) is not True:
            raise UsageError("mbn is true: files of this version always hold a stream bundle")
        return cls(doc["name"], Plan(doc["layer"], doc["codec"], _checked_codecs(doc.get("stream_codecs"))))


@dataclass(frozen=True)
class DirectorySpec:
    buckets: int = 16
    archive: bool = True  # false: a file of its own for each, without shared dictionaries
    autopick: bool = True  # false: each type's first plan, without trials
    sample_n: int = 2
    top_k: int = 2
    top_db_max: int = 10
    refresh_top: bool = False
    pools: dict[str, list[Plan]] = field(default_factory=dict)
    numbers_k: int = 64
    templates_k: int = 64

    @classmethod
    def load(cls, text: str | dict, buckets: int | None = None) -> DirectorySpec:
        doc = _document(text)
        _only(doc, {"spec", "name", "buckets", "archive", "autopick", "candidate_pools", "resources"}, "a directory pipeline")
        if not str(doc.get("spec", "")).endswith("dir_pipeline.v1"):
            raise UsageError("spec names the directory pipeline's version")
        pick = doc.get("autopick") or {}
        _only(pick, {"enabled", "sample_n", "top_k", "top_db_max", "refresh_top"}, "autopick")
        resources = doc.get("resources") or {}
        _only(resources, {"num_dict_v1", "tpl_dict_v0"}, "resources")
        sizes = {}
        for name, r in resources.items():
            _only(r, {"enabled", "k"}, name)
            sizes[name] = int(r.get("k", 64)) if r.get("enabled", True) else 0
        pools = {}
        for kind, plans in (doc.get("candidate_pools") or {}).items():
            if kind not in TYPES:
                raise UsageError(f"no bucket type {kind!r}")
            for p in plans:
                _only(p, {"layer", "codec", "stream_codecs", "note"}, "a plan")
            pools[kind] = [Plan(p["layer"], p["codec"], _checked_codecs(p.get("stream_codecs")), p.get("note", "")) for p in plans]
        n, flags = buckets or doc.get("buckets", 16), {"archive": doc.get("archive", True), "autopick": pick.get("enabled", True), "refresh_top": pick.get("refresh_top", False)}
        counts = {"sample_n": pick.get("sample_n", 2), "top_k": pick.get("top_k", 2), "top_db_max": pick.get("top_db_max", 10)}
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 1
        if not whole(n) or not all(map(whole, counts.values())) or counts["sample_n"] > 8:
            raise UsageError("buckets, top_k and top_db_max are 1 or more, sample_n 1 to 8")
        if not all(isinstance(x, bool) for x in flags.values()):
            raise UsageError(f"{', '.join(flags)}: true or false")
        return cls(buckets=n, pools=pools, numbers_k=sizes.get("num_dict_v1", 64), templates_k=sizes.get("tpl_dict_v0", 64), **flags, **counts)
