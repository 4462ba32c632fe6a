"""Removing duplicates: exact, canonical, by shared signatures, and by distance of bit hashes.

Hash distance joins are banded: hashes within a distance t share at least one of t + 1 bands, so candidates come from
an equi-join on (band, bits) and only those are compared. The greedy rule (keep a row if no kept earlier row is near)
is resolved in rounds over the edges, which leave out rows without a neighbour altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigraph.functions import text as X
from lumigraph.functions import url as U
from lumigraph.operators.skew import attach_group_values, salted_self_join
from lumigraph.session import persist_shared


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key. min_by on a struct combines on the map side, so a frequent key is no hot task."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__first")).select(*keys, "__first.*")


def canonical_image_key(u: Column) -> Column:
    """host|path without size and preset segments, repeats, extension, crop ending and the last of several number groups; empty if not http."""
    parts = F.filter(F.split(U.path(F.trim(u)), "/"), lambda p: (p != "") & ~p.rlike(r"^image_\d+_\d+$") & ~p.startswith("content_image_"))
    parts = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) == p), acc).otherwise(F.concat(acc, F.array(p))))

    def key(ps: Column) -> Column:
        s = F.regexp_replace(F.element_at(ps, -1), r"(?<=[^.])\.[^.]+$", "")
        s = F.when(s.contains(".r_d."), F.substring_index(s, ".r_d.", 1)).otherwise(s)
        s = F.when(s.rlike(r"(?:-\d+){2,}$"), F.regexp_replace(s, r"-\d+$", "")).otherwise(s)
        return F.when(F.size(ps) == 0, "").otherwise(F.array_join(F.concat(F.slice(ps, 1, F.greatest(F.size(ps) - 1, F.lit(0))), F.array(s)), "/"))

    k = F.transform(F.array(parts), key)[0]
    return F.when(U.scheme(F.trim(u)).isin("http", "https"), F.concat(U.netloc(F.trim(u)), F.lit("|"), k)).otherwise("")


def best_of_group(df: DataFrame, key: str, by: list[Column], order: str) -> DataFrame:
    """The greatest row of each key (first on ties); rows with an empty key all stay."""
    rank = F.struct(*[F.coalesce(b, F.lit(0)).cast("double").alias(f"b{i}") for i, b in enumerate(by)], (-F.col(order)).alias("o"))
    # rows without a key are groups of their own, so that the key is worked out in one pass
    alone = df.withColumn("__alone", F.when(F.coalesce(F.col(key), F.lit("")) == "", F.monotonically_increasing_id()))
    return alone.groupBy(key, "__alone").agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), rank).alias("__best")).select(key, "__best.*")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("group_size"))


def metadata_signatures(site: Column, fields: dict[str, Column], w: Column, h: Column) -> Column:
    """Array of SHA-1 signatures of the telling texts of a row, alone and with its aspect ratio and size."""
    out = []
    for name, c in fields.items():
        n = X.normal_meta(c)
        tokens = F.split(n, " ")
        ok = (F.length(n) >= 12) & (F.size(tokens) >= 2) & (F.size(F.array_except(tokens, F.array(*map(F.lit, X.GENERIC_TOKENS)))) > 0)
        base = F.concat_ws("|", site, F.lit(name), n)
        out += [F.when(ok, F.sha1(x)) for x in (base, F.concat(base, F.lit("|r:"), X.ratio_bucket(w, h).cast("string")), F.concat(base, F.lit("|d:"), X.dim_bucket(w, h)))]
    return F.array_compact(F.array(*out))


def signature_owners(df: DataFrame, id_col: str, signatures: str) -> DataFrame:
    """(id, owner): rows that share a signature with an earlier one, and the earliest such row."""
    long = df.select(F.col(id_col).alias("id"), F.explode(signatures).alias("sig"))
    first = long.groupBy("sig").agg(F.min("id").alias("owner"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return long.join(first, "sig").filter("owner < id").groupBy("id").agg(F.min("owner").alias("owner"))


def sign_hash(embedding: Column) -> Column:
    """One bit per dimension (64 at most): whether the value is positive."""
    return F.aggregate(F.transform(embedding, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, v: a.bitwiseOR(v))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(df: DataFrame, id_col: str, hash_col: str, within: int, bits: int = 64) -> DataFrame:
    """(a, b, distance) of all pairs of ids a < b whose hashes differ in at most so many bits.

    Bands that many hashes share (blank pictures, constant colours) are paired by several tasks.
    """
    n = within + 1
    cuts = [round(i * bits / n) for i in range(n + 1)]
    bands = F.array(*[F.xxhash64(F.lit(i), F.call_function("shiftrightunsigned", F.col(hash_col), F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1))) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
    long = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), F.explode(bands).alias("band"))
    a, b = (long.select("band", F.col("id").alias(s), F.col("h").alias(f"h{s}")) for s in "ab")
    counts = long.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    close = salted_self_join(a, b, "band", counts, "n", "a").filter((F.col("a") < F.col("b")) & (distance(F.col("ha"), F.col("hb")) <= within))
    return close.select("a", "b", distance(F.col("ha"), F.col("hb")).alias("distance")).distinct()


def greedy_kept(pairs: DataFrame) -> DataFrame:
    """(id, kept) of every id in pairs (a < b): in order of ids one is kept if no kept smaller id is its neighbour."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    state = persist_shared(ids.withColumn("kept", F.lit(None).cast("boolean")), "greedy")
    pairs = persist_shared(pairs.select("a", "b"), "edges")
    while True:
        before = pairs.join(state.select(F.col("id").alias("a"), F.col("kept").alias("a_kept")), "a").groupBy(F.col("b").alias("id")).agg(
            F.max(F.coalesce(F.col("a_kept"), F.lit(False))).alias("near_kept"), F.max(F.col("a_kept").isNull()).alias("open")
        )
        decided = F.when(F.col("near_kept"), False).when(~F.coalesce(F.col("open"), F.lit(False)), True)
        state = persist_shared(state.join(before, "id", "left").select("id", F.coalesce("kept", decided).alias("kept")), "greedy")
        if not state.filter("kept is null").limit(1).count():
            return state


def greedy_near_duplicates(df: DataFrame, id_col: str, hash_col: str, within: int) -> DataFrame:
    """df with kept and, for dropped rows, the nearest kept earlier row (the earliest on ties).

    Equal hashes are compared through the first of them: n copies make n rows, not all their pairs.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h")).filter("h is not null")
    firsts = persist_shared(rows.groupBy("h").agg(F.min("id").alias("id")), "firsts")
    pairs = persist_shared(near_pairs(firsts, "id", "h", within), "pairs")
    state = persist_shared(firsts.join(greedy_kept(pairs), "id", "left").select("id", "h", F.coalesce("kept", F.lit(True)).alias("kept")), "state")
    # a copy of a kept first matches it; other dropped rows match the nearest kept first before them
    both = pairs.select(F.col("a").alias("k"), F.col("b").alias("of"), "distance").unionAll(pairs.select(F.col("b").alias("k"), F.col("a").alias("of"), "distance"))
    near = both.join(state.filter("kept").select(F.col("id").alias("k")), "k", "left_semi")
    own = state.filter("kept").select("h", F.col("id").alias("k"), F.lit(0).alias("distance"))
    others = near.join(state.filter("not kept").select(F.col("id").alias("of"), "h"), "of").select("h", "k", "distance")
    choices = own.unionAll(others).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("distance", "k"))).alias("choices"))  # kept firsts near one hash
    earlier = F.get(F.filter("choices", lambda c: c["k"] < F.col("id")), F.lit(0))
    found = rows.join(choices, "h").select(F.col("id").alias(id_col), earlier.alias("m")).filter("m is not null")
    dropped = found.select(id_col, F.col("m.k").alias("matched"), F.col("m.distance").alias("matched_distance")).dropDuplicates([id_col])
    return df.join(dropped, id_col, "left").withColumn("kept", F.col("matched").isNull())


def hash_set_matches(a: DataFrame, b: DataFrame, id_col: str, hashes: str, within: int, words: int = 4) -> DataFrame:
    """(a, b, distance): ids whose sets of long hashes (arrays of 64-bit words) hold a pair that differs in at most so many bits; the least distance.

    A hash is cut into within + 1 bands of bytes at least one of which a near hash shares; candidates meet on a band.
    """
    n_bytes = 8 * words
    size = max(1, n_bytes // (within + 1))
    if (within + 1) * size > n_bytes:
        raise ValueError(f"hashes of {n_bytes * 8} bits can't be cut into {within + 1} bands of whole bytes")

    def banded(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col(id_col).alias(name), F.explode(hashes).alias("h"))
        text = F.array_join(F.transform("h", lambda w: F.lpad(F.hex(w), 16, "0")), "")
        cuts = [i * size * 2 for i in range(within + 1)] + [n_bytes * 2]
        parts = F.array(*[F.xxhash64(F.lit(i), F.substring(F.col("t"), lo + 1, hi - lo)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])
        return one.withColumn("t", text).select(name, F.col("h").alias(f"h_{name}"), F.explode(parts).alias("band"))

    left, right = banded(a, "a"), banded(b, "b")
    counts = left.select("band").unionAll(right.select("band")).groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    gap = F.aggregate(F.zip_with("h_a", "h_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, v: acc + v)
    close = salted_self_join(left, right, "band", counts, "n", "a").filter("a <> b").select("a", "b", gap.alias("distance")).filter(F.col("distance") <= within)
    return close.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def audit_log(df: DataFrame, id_col: str, reasons: dict[str, Column]) -> DataFrame:
    """(id, reason, matched) in long form: one row for each reason (a column with the id matched, or null) by which a row is a duplicate."""
    events = F.array(*[F.struct(F.lit(n).alias("reason"), c.cast("string").alias("matched")) for n, c in reasons.items()])
    return df.select(F.col(id_col).alias("id"), F.explode(events).alias("e")).select("id", "e.reason", "e.matched").filter("matched is not null")


def hex_similarity(a: Column, b: Column) -> Column:
    """1 - differing digits / four times the length."""
    differ = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda x: x))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(1 - differ / (F.greatest(F.length(a), F.length(b)) * 4))


def file_duplicates(df: DataFrame, name: str, w: str, h: str, age: str) -> DataFrame:
    """kept flag: the oldest row of each (width, height, file name), or of the name where sizes are unknown."""
    keys = {"__name": F.lower(F.coalesce(name, F.lit(""))), "__w": F.coalesce(w, F.lit(-1)), "__h": F.coalesce(h, F.lit(-1))}
    rows = df.withColumns(keys)
    oldest = rows.groupBy(*keys).agg(F.min(age).alias("__oldest"), F.count("*").alias("__n"))
    return attach_group_values(rows, oldest, [*keys], "__n", age).withColumn("kept", F.col(age) == F.col("__oldest")).drop(*keys, "__oldest", "__n")
