"""Fetching pages and pictures as a table operation: one row per address with its answer or its failure.

How an address is fetched is a function given by name (module:function), so that tests and offline runs answer from
records: it gets the address and the headers and gives (status, content type, bytes), or raises. Failures are rows with
an error, never a failed job; an address that occurs many times is fetched once; hosts are spread over tasks so that
each is asked by few at a time.
"""

from __future__ import annotations

import importlib
import json
import struct
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigraph.functions import url as U
from lumigraph.operators.skew import attach_group_values
from lumigraph.session import persist_shared

ANSWER = "http_status int, content_type string, content binary, n_bytes bigint, fetched boolean, error string"
PICTURE = "picture_format string, picture_width int, picture_height int"
#: Bounds of a stored picture in bytes.
LEAST_BYTES, MOST_BYTES = 5_000, 10_000_000


def http(url: str, headers: dict[str, str], timeout: float = 15.0) -> tuple[int, str, bytes]:
    """The fetcher for live addresses, by the standard library."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "lumigraph", **headers}), timeout=timeout) as answer:
        return int(answer.status), answer.headers.get("Content-Type", ""), answer.read()


def fetch(df: DataFrame, url: str, fetcher: str = "lumigraph.sources.fetch:http", headers: dict[str, str] | None = None, pause: float = 0.0, tasks_per_host: int = 1) -> DataFrame:
    """df with the answer for its address. Written before it is given back, so that nothing is fetched twice.

    pause is the time in seconds between two requests of a task; rows without an address are failures.
    """
    module, name = fetcher.split(":")
    fixed = dict(headers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = getattr(importlib.import_module(module), name)
        for b in batches:
            rows = []
            for u in b["__url"].tolist():
                try:
                    status, kind, data = get(u, fixed)
                    ok = 200 <= status < 300
                    rows.append((u, status, kind, bytes(data), len(data), ok, None if ok else f"status {status}"))
                except Exception as e:  # one address must not end the task
                    rows.append((u, None, None, None, None, False, f"{type(e).__name__}: {e}"))
                if pause:
                    time.sleep(pause)
            out = pd.DataFrame(rows, columns=["__url", *[c.split()[0] for c in ANSWER.split(", ")]])
            yield out.astype({"http_status": "Int32", "n_bytes": "Int64"})

    counted = df.select(F.trim(url).alias("__url")).filter("__url <> ''").groupBy("__url").agg(F.count("*").alias("__n"))
    spread = counted.withColumn("__host", U.netloc(F.col("__url"))).withColumn("__part", F.pmod(F.xxhash64("__url"), F.lit(tasks_per_host)))
    answers = spread.repartition("__host", "__part").select("__url").mapInPandas(run, f"__url string, {ANSWER}")
    answers = persist_shared(answers, "answers").join(counted, "__url")
    there = df.withColumn("__url", F.trim(url))
    known = attach_group_values(there.filter("__url <> ''"), answers, ["__url"], "__n", url).drop("__n", "__url")
    none = there.filter("__url is null or __url = ''").drop("__url")
    for c in ANSWER.split(", "):
        n, t = c.split()
        none = none.withColumn(n, F.lit(False) if n == "fetched" else F.lit("no address") if n == "error" else F.lit(None).cast(t))
    return known.unionByName(none)


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows still to do, rows that an earlier run has done)."""
    have = done.select(*keys).distinct()
    return df.join(have, keys, "left_anti"), df.join(have, keys, "left_semi")


def totals(done_before: DataFrame, answers: DataFrame) -> DataFrame:
    """One row (ok, failed): what was done before counts as well done."""
    return answers.agg(F.count_if("fetched").alias("n_ok"), F.count_if(~F.col("fetched")).alias("failed")).crossJoin(done_before.agg(F.count("*").alias("before"))).select((F.col("n_ok") + F.col("before")).alias("ok"), "failed")


def header(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) as the first bytes of a picture tell; null for anything else."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", *struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return "gif", *struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return "bmp", w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return "webp", w & 0x3FFF, h & 0x3FFF
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data):  # segments up to the first frame header
            if data[at] != 0xFF:
                return None
            kind = data[at + 1]
            if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 0x01:
                at += 1 if kind == 0xFF else 2
                continue
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def with_header(df: DataFrame, content: str = "content") -> DataFrame:
    """df with format, width and height of the pictures in a column of bytes; null where the bytes are no picture."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [header(x) or (None, None, None) for x in b[content]]
            yield b.assign(picture_format=[x[0] for x in found], picture_width=pd.array([x[1] for x in found], "Int32"), picture_height=pd.array([x[2] for x in found], "Int32"))

    return df.mapInPandas(run, f"{fields}, {PICTURE}")


def rejection(content_type: Column, n_bytes: Column, width: Column, height: Column, least_side: int = 100) -> Column:
    """Why a fetched picture is not stored: its type, its bytes or its size; null where it is."""
    return (
        F.when(~F.coalesce(F.lower(content_type).startswith("image/"), F.lit(False)), "content_type").when(n_bytes < LEAST_BYTES, "too_small").when(n_bytes > MOST_BYTES, "too_large")
        .when(width.isNull(), "no_picture").when(F.least(width, height) < least_side, "too_low")
    )


def write_files(df: DataFrame, content: str, name: str, folder: str) -> DataFrame:
    """Write a column of bytes to files of the given names below a folder (file:, hdfs: or s3:); (name, stored_path, n_bytes) as a table.

    A task that runs again writes the same files again. Written before it is given back.
    """
    root = folder.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            rows = []
            for n, data in zip(b["name"], b["content"]):
                path = f"{base}/{n}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(data)
                rows.append((n, f"{root}/{n}", len(data)))
            yield pd.DataFrame(rows, columns=["name", "stored_path", "n_bytes"])

    chosen = df.select(F.col(name).alias("name"), F.col(content).alias("content")).filter("name is not null and content is not null")
    return persist_shared(chosen.mapInPandas(run, "name string, stored_path string, n_bytes bigint"), "stored")


def cookies(text: str) -> dict[str, str]:
    """Cookies of a JSON object, a JSON list of name and value, or a line name=value; other=value."""
    text = text.strip()
    if text[:1] == "{":
        return {str(k): str(v) for k, v in json.loads(text).items()}
    if text[:1] == "[":
        return {str(c["name"]): str(c["value"]) for c in json.loads(text) if "name" in c and "value" in c}
    return {k.strip(): v.strip() for k, v in (p.split("=", 1) for p in text.replace("\n", ";").split(";") if "=" in p)}
