"""Exact vector retrieval over a table of points."""

from __future__ import annotations

from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.vectors import fault, similarity
from granary.operators.lexical import bounded, in_scope, matches, scope_sums, with_scopes
from granary.operators.packing import MOST, packed, ranked

#: Queries that one pass over the points answers at most.
QUERIES = 1_000
#: Products of a query and a point that a task holds at once, in matrices of doubles; points that a partition by chunk has about.
PRODUCTS = 1_000_000
POINTS = 1_000
#: Products whose rows exact gives in the order of their scores, and queries of a pass of it; a task holds 8 bytes for each product.
#: With over 32,000 points, Parquet would find too many ids among a page's 20,000 rows and give up their dictionary.
ALIKE, ALIKE_QUERIES = 60_000_000, 2_000


def upserted(points: DataFrame, batch: DataFrame, dimension: int, distance: str = "cosine", normalized: bool = True) -> DataFrame:
    """points with those of batch added, or put in place of their namesakes. point_id, vector and payload columns.

    The whole batch is checked first: a faulty vector or a repeated id is an error, and nothing changes.
    """
    bad = batch.select("point_id", fault(F.col("vector"), dimension, distance, normalized).alias("fault")).where("fault is not null").limit(5).collect()
    if bad:
        raise ValueError(f"invalid vectors: {[(r.point_id, r.fault) for r in bad]}")
    if again := batch.groupBy("point_id").count().where("count > 1").limit(5).collect():
        raise ValueError(f"repeated points: {[r.point_id for r in again]}")
    return points.join(batch.select("point_id"), "point_id", "left_anti").unionByName(batch)


def removed(points: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """points without those of the documents (doc_id)."""
    return points.join(doc_ids.select("doc_id"), "doc_id", "left_anti")


def scored(points: DataFrame, queries: DataFrame, distance: str = "cosine") -> DataFrame:
    """(query_id, points' columns, score) of every point in a query's scope: kb_ids, filters (null: none), vector as vector.

    The queries are the side that is broadcast; filters are applied before anything is scored. The native form, one row for
    each pair: to check nearest and parents with.
    """
    q = bounded(queries.select("query_id", F.col("vector").alias("_q"), "kb_ids", "filters"), QUERIES)
    return points.join(q, in_scope(F.col("kb_id"), F.col("kb_ids")) & matches(F.col("values"), F.col("filters"))).withColumn("score", similarity(F.col("vector"), F.col("_q"), distance)).drop("_q", "kb_ids", "filters")


def exact(points: DataFrame, queries: DataFrame, distance: str = "cosine", digits: int = 12) -> DataFrame:
    """(query_id, point_id, score) of every query with every point in its scope, by blocked products; rounded to so many decimals,
    halves away from zero.

    The answer is as many rows as pairs. Those of up to ALIKE products come by score, so that equal scores follow each other:
    written to columnar files, with few digits, they take less than half the space that they take by query."""
    return _met(points, queries, "point_id", None, distance, alike=digits)


def maxima(points: DataFrame, queries: DataFrame, distance: str = "cosine") -> DataFrame:
    """(query_id, chunk_id, score) of every query with every chunk that has a point in its scope: the chunk's best point. Points
    are brought together by chunk, so that what is shuffled are points, and no row of the answer is."""
    n = min(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max(1, points.count()) // POINTS))
    return _met(points.repartition(n, "chunk_id").sortWithinPartitions("chunk_id"), queries, "chunk_id", None, distance, together=True)


def nearest(points: DataFrame, queries: DataFrame, k: int = MOST, distance: str = "cosine", strict: bool = False) -> DataFrame:
    """(query_id, point_id, score, rank): the k best points of each query (query_id, vector; kb_ids, filters if it has them) within
    its scope, ties by point_id. Scores that agree in 12 decimals tie. A point whose score is no finite number is left out, or, if
    strict, an error."""
    found = _met(points, queries, "point_id", k, distance, strict)
    return ranked(found, "query_id", ascending=distance == "euclid", tie="point_id").where(F.col("rank") <= k)


def parents(points: DataFrame, queries: DataFrame, k: int = MOST, distance: str = "cosine") -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query by their best point, ties by chunk_id.

    A chunk among the k best of all has its best point in some batch, and is among the k best of that one.
    """
    found = pooled(_met(points, queries, "chunk_id", k, distance), distance)
    return ranked(found, "query_id", ascending=distance == "euclid").where(F.col("rank") <= k)


def _met(points: DataFrame, queries: DataFrame, key: str, k: int | None, distance: str, strict: bool = False, together: bool = False, alike: int | None = None) -> DataFrame:
    """(query_id, key, score): the k best keys (None: all) of each query in each batch of points, and those that tie with the last.

    Blocks of QUERIES queries (alike: ALIKE_QUERIES) meet all points, in a pass for each block: a batch of points is matrix products of at most PRODUCTS
    scores, of which each query's k best go on. Queries by points are never rows; a task sends k rows for each query and batch.
    The queries come to the driver a block at a time. together (for k None): points of a key are in one partition and follow each
    other, and the key's best score is given once. alike (for k None): decimals of the scores; rows of ALIKE products come by
    score, one for each query and point, whatever their ids.
    """
    scope = [c for c in ("kb_ids", "filters") if c in queries.columns]
    rows, most = queries.select("query_id", "vector", *scope).toLocalIterator(), QUERIES if alike is None else ALIKE_QUERIES
    blocks = [_block(points, queries, list(islice(rows, most)), key, k, distance, strict, together=together, alike=alike)]
    while block := list(islice(rows, most)):
        blocks.append(_block(points, queries, block, key, k, distance, strict, together=together, alike=alike))
    return reduce(DataFrame.unionByName, blocks)


def _block(points: DataFrame, queries: DataFrame, rows: list, key: str, k: int | None, distance: str, strict: bool, visits: np.ndarray | None = None, together: bool = False, alike: int | None = None) -> DataFrame:
    """_met for the collected queries in rows. visits: for each query and value of the points' column cluster whether they meet;
    of other points no product is taken."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = [r.query_id for r in rows]
    wanted = np.array([r.vector for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)
    sign = -1.0 if distance == "euclid" else 1.0
    # distinct scopes with the queries in them: what a point must be, and the metadata that has to be looked at
    scopes: dict[tuple, list[int]] = {}
    for n, r in enumerate(rows):
        kbs, filters = (r[c] if c in r else None for c in ("kb_ids", "filters"))
        scopes.setdefault((None if kbs is None else tuple(sorted(set(kbs))), tuple(sorted((filters or {}).items()))), []).append(n)
    keys = sorted({f for _, filters in scopes for f, _ in filters})

    def signed(s: np.ndarray) -> np.ndarray:
        """Rounds and signs s in place, alike: as whole numbers; -inf for, and the places of, what is no finite number."""
        odd = ~np.isfinite(s)
        if alike is None:
            np.round(s, 12, out=s)
        else:
            s *= 10.0**alike
            s += np.copysign(0.5, s)
            np.trunc(s, out=s)
        s *= sign
        s[odd] = -np.inf
        return odd

    def scores(part: slice, own, cluster, insides, ids) -> np.ndarray:
        """Of the queries in part with the points of a batch, signed so that the largest is the best; -inf: not met."""
        asked = wanted[part]
        if visits is None:
            s = products(asked, own, distance)
            odd = signed(s)
        else:
            s, odd = np.full((len(asked), len(own)), -np.inf), np.zeros((len(asked), len(own)), bool)
            for c in np.unique(cluster):
                place = np.ix_(np.flatnonzero(visits[part, c]), np.flatnonzero(cluster == c))
                some = products(asked[place[0].ravel()], own[place[1].ravel()], distance)
                odd[place] = signed(some)
                s[place] = some
        for inside, members in insides:
            here = members[(members >= part.start) & (members < part.stop)] - part.start
            if strict and odd[np.ix_(here, inside)].any():
                bad = ids.take(pa.array(np.flatnonzero(inside & odd[here].any(0))[:5])).to_pylist()
                raise ValueError(f"points without a finite score: {bad}")
            if not inside.all():
                s[np.ix_(here, ~inside)] = -np.inf
        return s

    def run(batches):
        held, last = np.full(len(wanted), -np.inf), None  # together: the scores of the key that the next batch may go on with
        named = pa.array(names, kind)

        def rows_of(s, start, found_keys, q, p):
            return pa.RecordBatch.from_arrays([named.take(pa.array(q + start)), found_keys.take(pa.array(p)), pa.array(sign * s[q, p])], ["query_id", key, "score"])

        for batch in gathered(batches, max(1, ALIKE // ALIKE_QUERIES)) if alike is not None else batches:
            if not batch.num_rows or not len(wanted):
                continue
            own = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
            cluster = None if visits is None else batch.column(batch.num_columns - 1).to_numpy()
            metadata = {f: np.array(batch.column(3 + j).to_pylist(), object) for j, f in enumerate(keys)}
            kb = np.array(batch.column(2).to_pylist(), object)
            text, there = kb.astype(str), kb != None  # noqa: E711
            insides = []
            for (kbs, filters), members in scopes.items():
                inside = np.ones(len(kb), bool) if kbs is None else np.isin(text, kbs) & there
                for f, value in filters:
                    inside &= metadata[f] == value
                insides.append((inside, np.array(members)))
            step = max(1, PRODUCTS // batch.num_rows)
            if alike is not None:
                wide = max(1, ALIKE // batch.num_rows)
                for start in range(0, len(wanted), wide):
                    stop = min(start + wide, len(wanted))
                    parts = (slice(at, min(at + step, stop)) for at in range(start, stop, step))
                    tile = (scores(part, own, cluster, insides, batch.column(0)) for part in parts)
                    for values, places in by_score(tile, (stop - start) * batch.num_rows):
                        q, p = np.divmod(places, batch.num_rows)
                        values = sign * values / 10.0**alike + 0.0  # no negative zero
                        yield pa.RecordBatch.from_arrays([named.take(pa.array(q + start)), batch.column(0).take(pa.array(p)), pa.array(values)], ["query_id", key, "score"])
                continue
            codes = batch.column(0).dictionary_encode()
            which = codes.indices.to_numpy()
            order = np.argsort(which, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(which[order]) > 0])
            own_keys = codes.dictionary
            before = last
            if together:
                last = own_keys.slice(len(own_keys) - 1)

            def best(part: slice) -> np.ndarray:
                s = scores(part, own, cluster, insides, batch.column(0))
                return s if len(begins) == len(which) else np.maximum.reduceat(s[:, order], begins, axis=1)

            for start in range(0, len(wanted), step):
                part = slice(start, min(start + step, len(wanted)))
                s = best(part)
                if together:
                    if before is not None and before.equals(own_keys.slice(0, 1)):
                        s[:, 0] = np.maximum(s[:, 0], held[part])
                    elif before is not None:
                        q = np.flatnonzero(held[part] > -np.inf)
                        yield rows_of(held[part, None], start, before, q, np.zeros_like(q))
                    held[part] = s[:, -1]
                    s = s[:, :-1]
                    if not s.shape[1]:
                        continue
                m = min(k or s.shape[1], s.shape[1])
                # all that ties with the k-th, so that ids decide
                floor = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m, None] if m < s.shape[1] else -np.inf
                q, p = np.nonzero((s >= floor) & (s > -np.inf))
                yield rows_of(s, start, own_keys, q, p)
        if last is not None:
            q = np.flatnonzero(held > -np.inf)
            yield rows_of(held[:, None], 0, last, q, np.zeros_like(q))

    kinds = queries.schema["query_id"].dataType, points.schema[key].dataType
    kind = to_arrow_type(kinds[0])
    kb = F.col("kb_id").cast("string") if "kb_id" in points.columns else F.lit(None).cast("string")
    slim = points.select(key, "vector", kb.alias("kb_id"), *[F.col("values")[f].alias(f"_f{j}") for j, f in enumerate(keys)], *["cluster"] * (visits is not None))
    return slim.mapInArrow(run, f"query_id {kinds[0].simpleString()}, {key} {kinds[1].simpleString()}, score double")


def gathered(batches, rows: int):
    """The batches dealt anew to such of that many rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            whole, at = pa.concat_batches(held), 0
            while n - at >= rows:
                yield whole.slice(at, rows)
                at += rows
            held, n = [whole.slice(at)], n - at
    if n:
        yield pa.concat_batches(held)


def by_score(pieces, size: int):
    """(values, places) of the finite numbers among size whole numbers, given in pieces, by value and about PRODUCTS / 4 at a time.

    A value and its place are one integer of 64 bits, so that nothing else is held or sorted. Pieces with values too large for
    that go out by themselves."""
    bits = size.bit_length()
    held, n, at, sent = np.empty(size, np.int64), 0, 0, max(1, PRODUCTS // 4)
    for piece in pieces:
        values = piece.ravel()
        place = np.flatnonzero(values > -np.inf)
        values = values[place]
        place += at
        at += piece.size
        if len(values) and np.abs(values).max() >= 2.0 ** (63 - bits):
            order = np.argsort(values)
            for start in range(0, len(order), sent):
                own = order[start : start + sent]
                yield values[own], place[own]
            continue
        held[n : n + len(place)] = values.astype(np.int64) << bits | place
        n += len(place)
    held = held[:n]
    held.sort()
    for start in range(0, n, sent):
        own = held[start : start + sent]
        yield (own >> bits).astype(float), own & ((1 << bits) - 1)


def products(a: np.ndarray, b: np.ndarray, distance: str) -> np.ndarray:
    """Scores of the rows of a with those of b; a cosine with a zero vector is no number. Two matrices are held at most."""
    s = a @ b.T
    if distance == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            s /= np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None]
    if distance == "euclid":
        squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None]
        s *= -2
        s += squares
        squares *= 1e-4
        one, two = np.nonzero(s < squares)  # where the difference of large numbers has lost its digits
        del squares
        few = max(1, PRODUCTS // max(1, a.shape[1]))  # many copies: pairs of whole vectors
        for at in range(0, len(one), few):
            i, j = one[at : at + few], two[at : at + few]
            s[i, j] = ((a[i] - b[j]) ** 2).sum(1)
        np.sqrt(s, out=s)
    return s


def candidates(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, candidates): how many points lie in each query's scope, by counts of knowledge bases and filters."""
    scoped = with_scopes(queries)
    return scoped.select("query_id", "scope").join(scope_sums(points.withColumn("length", F.lit(0)), scoped), "scope").select("query_id", F.col("n").alias("candidates"))


def point_faults(points: DataFrame, contract: str, kb_ids: DataFrame, dimension: int, distance: str = "cosine", normalized: bool = True) -> DataFrame:
    """(point_id, fault) of points (point_id, vector, contract_id, kb_id, doc_id) that no search may return: those of another
    contract, of a knowledge base that isn't among kb_ids, named unlike their knowledge base, or whose vector is faulty."""
    known = bounded(kb_ids.select(F.col("kb_id").alias("_kb")).distinct(), QUERIES)
    alien = F.when(~F.col("contract_id").eqNullSafe(F.lit(contract)), "foreign contract").when(F.col("_kb").isNull(), "unknown knowledge base")
    alien = alien.when(~F.coalesce(F.col("doc_id").startswith(F.concat("kb_id", F.lit(":"))), F.lit(False)), "document of another knowledge base")
    said = F.coalesce(alien, fault(F.col("vector"), dimension, distance, normalized))
    return points.join(known, F.col("kb_id") == F.col("_kb"), "left").select("point_id", said.alias("fault")).where("fault is not null")


def hit_faults(hits: DataFrame, points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, point_id, fault) of hits (query_id, point_id, score) that a right search can't have returned: no such point, a
    score that is no finite number, or a point outside the query's knowledge bases or filters. One row a hit, the first fault."""
    own = points.select("point_id", F.col("kb_id").alias("_kb"), F.col("values").alias("_values"), F.lit(True).alias("_there"))
    met = hits.join(own, "point_id", "left").join(queries.select("query_id", "kb_ids", "filters"), "query_id", "left")
    finite = F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))
    said = F.when(F.col("_there").isNull(), "unknown point").when(~finite, "score isn't finite").when(~in_scope(F.col("_kb"), F.col("kb_ids")), "outside the knowledge bases").when(~matches(F.col("_values"), F.col("filters")), "outside the filters")
    return met.select("query_id", "point_id", said.alias("fault")).where("fault is not null")


def pooled(hits: DataFrame, distance: str = "cosine") -> DataFrame:
    """(query_id, chunk_id, score): a chunk's best point; for euclid the least is the best."""
    best: Column = F.min("score") if distance == "euclid" else F.max("score")
    return hits.groupBy("query_id", "chunk_id").agg(best.alias("score"))


def resolved(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """hits (chunk_id, doc_id, source_hash, kb_id of the index) that don't agree with their chunk: index and text differ."""
    c = chunks.select("chunk_id", F.col("doc_id").alias("_d"), F.col("source_hash").alias("_s"), F.col("kb_id").alias("_k"))
    return hits.join(c, "chunk_id", "left").where("_d is null or _d <> doc_id or _s <> source_hash or _k <> kb_id").drop("_d", "_s", "_k")


def search(points: DataFrame, chunks: DataFrame, queries: DataFrame, distance: str = "cosine") -> DataFrame:
    """Ranked and packed hits of queries (query_id, vector, kb_ids, filters, top_k, max_chars), chunks by their best point."""
    hits = parents(points, queries, distance=distance).join(queries.select("query_id", "top_k", "max_chars"), "query_id").where(F.col("rank") <= F.col("top_k"))
    return packed(hits.join(chunks.drop("values"), "chunk_id"))
