"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set is its distinct shingles of ``size`` words. Documents with equal sets become one class.
A class has a signature of ``K`` coordinates; its tokens are the coordinate-value pairs. Two sets of
similarity 0.8 agree in 80 % of the coordinates on average, so pairs that agree in at least ``T`` are
wanted. Tokens are ordered by how many classes hold them, the rarest first. A token that only one class
holds cannot agree with anything, and pairs with ``T`` agreements share one of the first ``c - T + 1`` of a
class's ``c`` shared tokens (prefix). The longest lists stand at the end of the order and are skipped.

Lists are not expanded into pairs. Each member meets the first member of its list; collisions are counted
per pair, signatures compared, and links confirmed on the full sets of words. Only where the members of a
list still lie in different components do the remaining pairs across components follow, by the same test.

Defined results: null, empty and blank texts have no shingle, are their own component and link with
nothing; a text of fewer words than ``size`` is one shingle; repeated rows with one id share a component
and are each returned, an id with several texts links what any of them is similar to; a null id has no
component (null) and is kept; other columns are not read; an empty table gives no rows. The filter goes by texts:
of an id with unlike texts each stays unless it is similar to another text, so no text is lost. Inside, the
rows of such ids are named by a 64-bit hash of id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import by_ids, id_and_text, mix64, text_slices, word_hashes
from seqloom.llm.components import components
from seqloom.session import fits, materialize

K = 64
T = 36  # at similarity 0.8 a pair has fewer agreements with a probability below 1e-5
SHINGLE_WORDS = 4
THRESHOLD = (80, 100)
OPEN_ROUNDS = 2  # further rounds of leaders before all open pairs are compared

_ROLL = [int(x) | 1 for x in mix64(np.arange(101, 133, dtype=np.uint64))]
_SEEDS = mix64(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = word_hashes(text.encode("utf-8").lower())
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for i in range(min(size, len(words))):
        runs += words[i : i + n] * np.uint64(_ROLL[i])
    return np.unique(mix64(runs))


def signature(hashes: np.ndarray, block: int = 8192) -> np.ndarray:
    """The ``K`` minima as 32-bit numbers."""
    low = np.full(K, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), block):
        part = hashes[at : at + block]
        for i in range(K):
            h = (part ^ _SEEDS[i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            low[i] = min(low[i], h.min())
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def shingle_set(text: str, size: int) -> set[tuple[bytes, ...]]:
    words = text.encode("utf-8").lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size))))


def keyed(docs: DataFrame, several: DataFrame | None = None) -> DataFrame:
    """``doc_id, text, known, code``: rows under their id, or under a hash of id and text where ``several`` texts
    have the id; ``known`` is the id itself."""
    own = docs.withColumns({"known": F.col("doc_id").cast("long"), "code": F.xxhash64("text")})
    if several is None:
        return own.select(F.col("known").alias("doc_id"), "text", "known", "code")
    marked = own.join(F.broadcast(several) if fits(several) else several, "known", "left")
    key = F.when(F.col("one").isNotNull(), F.xxhash64("known", "code")).otherwise(F.col("known"))
    return marked.select(key.alias("doc_id"), "text", "known", "code")


def signatures(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``known, code, n_shingles, digest, sig`` of every row; the digest stands for the whole set and
    is null for an empty one."""
    schema = pa.schema(
        [("known", pa.int64()), ("code", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string()), ("sig", pa.list_(pa.int32()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            known, codes, counts, digests, sigs = [r["known"] for r in rows], [r["code"] for r in rows], [], [], []
            for text in texts:
                hashes = shingle_hashes(text, size)
                counts.append(len(hashes))
                full = len(hashes) > 0
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest() if full else None)
                sigs.append(signature(hashes) if full else None)
            columns = [pa.array(c, f.type) for c, f in zip((known, codes, counts, digests, sigs), schema)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    given = keyed(docs).select(F.struct("known", "code"), "text")
    return given.mapInArrow(run, "known long, code long, n_shingles long, digest string, sig array<int>")


def _agreements(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _prefix_postings(classes: DataFrame) -> DataFrame:
    """``token, rep, n``: each class under the tokens of its prefix."""
    tokens = classes.select("rep", "n", F.posexplode("sig").alias("coordinate", "value")).select(
        "rep", "n", F.xxhash64("coordinate", "value").alias("token")
    )
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(counts, "token")
    held = shared.groupBy("rep", "n").agg(F.collect_list(F.struct("df", "token")).alias("held"))  # K at most
    first = F.slice(F.array_sort("held"), F.lit(1), F.size("held") - T + 1)
    return held.where(F.size("held") >= T).select("rep", "n", F.explode(first).alias("h")).select("h.token", "rep", "n")


def _close_sizes(a: Column, b: Column) -> Column:
    part, whole = THRESHOLD
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def _candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` whose signatures agree in at least ``T`` coordinates."""
    sig = classes.select("rep", "sig")
    with_a = pairs.join(sig.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    with_b = with_a.join(sig.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return with_b.where(_agreements("sig_a", "sig_b") >= T).select("a", "b")


def confirm(pairs: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The pairs ``a, b`` of keys whose full sets of words are similar enough.

    The join brings the pairs of one first key together, so that its set is built once for many pairs; a
    frequent first key is split by adaptive execution.
    """
    part, whole = THRESHOLD
    pairs = materialize(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = by_ids(docs.select("doc_id", "text"), materialize(ends, "ends"), "doc_id", "left_semi")
    texts = materialize(texts.dropDuplicates(["doc_id"]), "texts")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    joined = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for i in range(batch.num_rows):
                if a[i] != last or last is None:
                    last, left = a[i], shingle_set(batch.column(2)[i].as_py(), size)
                right = shingle_set(batch.column(3)[i].as_py(), size)
                both = len(left & right)
                if whole * both >= part * (len(left) + len(right) - both):
                    kept.append(i)
            columns = [pa.array([x[i] for i in kept], pa.int64()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return joined.mapInArrow(run, "a long, b long")


def links(classes: DataFrame, docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """Links between classes ``rep, n, sig`` that suffice for their components; every one is confirmed."""
    postings = materialize(_prefix_postings(classes), "postings")
    leaders = postings.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count(F.lit(1)).alias("members"))
    led = postings.join(leaders.where("members > 1"), "token")
    near = led.where((F.col("rep") != F.col("lead.rep")) & _close_sizes(F.col("n"), F.col("lead.n")))
    counted = near.groupBy(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).agg(F.count(F.lit(1)).alias("collisions"))
    first = materialize(confirm(_candidates(counted.select("a", "b"), classes), docs, size), "links")
    # Lists with members of several components besides the leader: the pairs across components are still open.
    named = _named(postings, components(first))
    lead = leaders.where("members > 2").select("token", F.col("lead.rep").alias("lead"))
    open_rows = named.join(lead, "token").where(F.col("rep") != F.col("lead")).drop("lead")
    rest = materialize(_spanning(open_rows), "open")
    if rest.isEmpty():
        return first
    found = first
    for _ in range(OPEN_ROUNDS):
        # Now the member with the fewest shingles of its own leads its list: it is the likest to the others.
        rest = materialize(_spanning(_possible(rest, docs, size)), "open")
        lead = F.min(F.struct(F.col("own") / F.col("n"), "rep", "n", "own", "component")).alias("l")
        led = rest.join(rest.groupBy("token").agg(lead), "token")
        pairs = led.select(*[F.col(c) for c in _MEMBER], *[F.col(f"l.{c}").alias(f"{c}_b") for c in _MEMBER])
        found = materialize(found.unionByName(_tested(pairs, classes, docs, size)), "links")
        rest = _named(rest.drop("component"), components(found))
    rest = materialize(_spanning(_possible(_spanning(rest), docs, size)), "open")
    if rest.isEmpty():
        return found
    other = rest.select("token", *[F.col(c).alias(f"{c}_b") for c in _MEMBER])
    pairs = rest.join(other, ["token"]).where(F.col("rep") < F.col("rep_b"))
    return found.unionByName(materialize(_tested(pairs, classes, docs, size), "links"))


_MEMBER = ["rep", "n", "own", "component"]


def _tested(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The links among pairs of members (the second one's columns end in ``_b``) of different components."""
    shared = F.least(F.col("n") - F.col("own"), F.col("n_b") - F.col("own_b"))
    wanted = pairs.where((F.col("component") != F.col("component_b")) & _similar(shared, F.col("n"), F.col("n_b")))
    counted = wanted.groupBy(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b"))
    collisions = counted.agg(F.count(F.lit(1)).alias("collisions"))
    return confirm(_candidates(collisions.select("a", "b"), classes), docs, size)


def _named(rows: DataFrame, label: DataFrame) -> DataFrame:
    named = rows.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    return named.withColumn("component", F.coalesce("component", "rep"))


def _similar(shared: Column, n_a: Column, n_b: Column) -> Column:
    part, whole = THRESHOLD
    return shared * whole >= (n_a + n_b - shared) * part


def _spanning(rows: DataFrame) -> DataFrame:
    """The rows ``token, rep, n, component`` of lists whose members lie in several components."""
    spans = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return rows.join(spans.select("token"), "token", "left_semi")


def _possible(rows: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The list members that can still link to another, with ``own``, the number of their own shingles.

    A shingle that no other open member holds is shared with none. So two members share at most the smaller
    of their other shingles. If that leaves a member below the threshold with any of its own size or larger,
    it is kept only where its list has a smaller one without this flaw that it might link to. In a group of
    copies edited in many places this leaves those alone that cannot link, without comparing them.
    """
    schema = pa.schema([("rep", pa.int64()), ("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches, 1 << 20):
            found = [shingle_hashes(t, size) for t in texts]
            reps = np.repeat(np.array(ids, dtype=np.int64), [len(h) for h in found])
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.concatenate(found).view(np.int64))], schema=schema)

    ids = materialize(rows.select(F.col("rep").alias("doc_id")).distinct(), "open-ids")
    held = by_ids(docs.select("doc_id", "text"), ids, "doc_id", "left_semi").mapInArrow(run, "rep long, shingle long")
    # A repeated row holds its shingles again: ids are compared, not rows.
    alone = held.groupBy("shingle").agg(F.min("rep").alias("rep"), F.max("rep").alias("last")).where("rep = last")
    counts = materialize(alone.groupBy("rep").agg(F.count(F.lit(1)).alias("own")), "own")
    stated = rows.select("token", "rep", "n", "component").join(counts, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    left = F.col("n") - F.col("own")
    marked = materialize(stated.withColumn("near", _similar(left, F.col("n"), F.col("n"))), "marked")
    smallest = marked.where("near").groupBy("token").agg(F.min("n").alias("least"))
    could = F.col("near") | (F.col("least") <= left) | _similar(left, F.col("n"), F.col("least"))
    return marked.join(smallest, "token").where(could).drop("near", "least")


def _grouped(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Of ``doc_id, text``: rows ``doc_id, known, n_shingles, digest``, classes ``digest, rep, first``, the links of
    the classes, and the ids with several texts, ``known, one``, if there are any."""
    rows = materialize(signatures(docs, size), "signatures")
    named = F.col("digest").isNotNull() & F.col("known").isNotNull()
    by_id = rows.where(named).groupBy("known").agg(F.min("digest").alias("one"), F.max("digest").alias("other"))
    several = materialize(by_id.where("one <> other").select("known", "one"), "several")
    key = F.col("known")
    if several.isEmpty():
        several = None
    else:
        rows = rows.join(several, "known", "left")
        key = F.when(F.col("one").isNotNull(), F.xxhash64("known", "code")).otherwise(key)
    rows = rows.select(key.alias("doc_id"), "known", "n_shingles", "digest", "sig")
    classes = rows.where(named).groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min("known").alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    classes = materialize(classes, "classes")
    found = links(classes.select("digest", "rep", "n", "sig"), keyed(docs, several), size)
    return rows.drop("sig"), classes.select("digest", "rep", "first"), found, several


def _components(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``digest, component, least``: the component of every class, and the smallest known id in it."""
    label = components(found).withColumnRenamed("node", "rep")
    named = classes.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = materialize(named.select("digest", "first", "component"), "named")
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    return named.join(least, "component").select("digest", "component", "least")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    rows, classes, found, several = _grouped(id_and_text(docs), size)
    if several is not None:  # the texts of one id belong together
        ends = rows.join(several, "known").select("one", "digest").distinct().where("one <> digest")
        reps = classes.select("digest", F.col("rep").alias("b"))
        ends = ends.join(reps, "digest").join(classes.select(F.col("digest").alias("one"), F.col("rep").alias("a")), "one")
        found = found.unionByName(ends.select("a", "b"))
    out = rows.join(_components(classes, found), "digest", "left")
    component = F.when(F.col("known").isNotNull(), F.coalesce("least", "known"))
    return out.select(
        F.col("known").alias("doc_id"), "n_shingles", component.alias("component_id"), F.col("known").eqNullSafe(component).alias("kept")
    )


def filter_documents(docs: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """Of each group of similar texts the one of the smallest id, with the columns it had.

    Rows without a word or an id all stay; of rows with one id and one set of words one stays. The row travels as
    one struct, so that no column of it can clash with a helper.
    """
    rows, classes, found, several = _grouped(id_and_text(docs, id_col), size)
    named = rows.where("known is not null and digest is not null").select(F.col("doc_id").alias("key"), "known", "digest")
    member = named.join(_components(classes, found), "digest")
    # The smallest id of a group, of several rows under it the one of the smallest key.
    kept = materialize(member.where("known = least").groupBy("component").agg(F.min("key").alias("key")), "kept")
    gone = materialize(named.select("key").distinct().join(kept.select("key"), "key", "left_anti"), "gone")
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    left = by_ids(keyed_rows(whole, several), gone, "key", "left_anti")
    # Of equal rows one stays; only these are shuffled.
    again = materialize(named.groupBy("key").count().where("count > 1").select("key"), "again")
    if not again.isEmpty():
        once = by_ids(left, again, "key", "left_semi").dropDuplicates(["key"])
        left = by_ids(left, again, "key", "left_anti").unionByName(once)
    return left.select(*[F.col("own")[c].alias(c) for c in docs.columns])


def keyed_rows(packed: DataFrame, several: DataFrame | None) -> DataFrame:
    """``key, own``: every packed row under the key of its text."""
    known = F.col("doc_id").cast("long")
    if several is None:
        return packed.select(known.alias("key"), "own")
    marked = packed.withColumn("known", known).join(F.broadcast(several) if fits(several) else several, "known", "left")
    key = F.when(F.col("one").isNotNull(), F.xxhash64("known", F.xxhash64("text"))).otherwise(F.col("known"))
    return marked.select(key.alias("key"), "own")
