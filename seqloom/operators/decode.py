"""Successors, greedy generation and beam search over a bigram model.

A continuation depends on the last word alone, so it is worked out once per word and not once per
line; prompts then take the continuation of their last word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.scores import brevity, hypothesis_step
from seqloom.functions.text import BOS, until
from seqloom.operators.elements import look_up_elements
from seqloom.operators.language_model import END_ID, NEVER_TARGET, UNK_ID, BigramModel, with_probability
from seqloom.operators.lookup import lookup
from seqloom.session import BROADCAST_BYTES, materialize, spread_small

RANK_DIGITS = 9  # log scores that agree to here are ties and go to the lower id
WALK_CELLS = 1 << 17  # followers that a pass of beam steps ranks side by side


def states(model: BigramModel) -> DataFrame:
    """Ids that may stand before another word: all but end, padding and end of sequence."""
    return model.vocabulary.where(
        ~F.col("tok").isin(*[m for m in NEVER_TARGET if m != BOS]) & (F.col("id") != END_ID)
    ).select(F.col("id").alias("prev"))


def top_successors(model: BigramModel, k: int, discount: float = 0.0) -> DataFrame:
    """``prev, next, p, rank``: the ``k`` most probable followers of every state.

    A follower never seen after a state can rank only when it is among the ``k`` best unseen
    words, and those are among the ``k`` most frequent words overall: the candidates of a state
    are its seen followers and that short list. ``discount`` takes from the end token's score.
    """
    possible = model.vocabulary.where(~F.col("tok").isin(*NEVER_TARGET)).select("id")
    frequent = (
        possible.join(model.unigrams, "id", "left")
        .orderBy(F.coalesce("n_next", F.lit(0)).desc(), "id")
        .limit(k + 1)
        .select("id")
    )
    short = [r[0] for r in frequent.collect()]  # k + 1 ids; one more, as the end token may lose its place
    every = states(model).select("prev", F.explode(F.array(*[F.lit(i) for i in short])).alias("next"))
    candidates = model.bigrams.unionByName(every.withColumn("n", F.lit(0).cast("long")))
    # A seen word of the short list stands twice, and its place without a count is never above the other.
    scored = with_probability(model, candidates, "prev", "next", counted="n")
    scored = scored.withColumn("p", brevity(F.col("p"), F.col("next") == END_ID, discount))
    # At most k + 1 rows of a state are such seconds, so 2 k + 1 rows hold k different words.
    score = F.round(F.ln("p"), RANK_DIGITS).desc_nulls_last()
    best = Window.partitionBy("prev").orderBy(score, "next", F.col("n").desc())
    front = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 2 * k + 1)
    again = F.row_number().over(Window.partitionBy("prev", "next").orderBy("rank"))
    first = front.withColumn("_nth", again).where(F.col("_nth") == 1).drop("_nth", "n")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("prev").orderBy("rank"))).where(F.col("rank") <= k)


def greedy_paths(model: BigramModel, gen_limit: int = 50) -> DataFrame:
    """``state, path``: ids generated after each state, up to the end token or ``gen_limit``.

    The greedy follower is a function of the state, so paths double: the path of length 2m is the
    path of length m and that of its last word. The number of joins grows with log(gen_limit).
    """
    step = materialize(top_successors(model, 1).select(F.col("prev").alias("state"), "next"), "greedy")
    paths = step.select("state", F.array("next").alias("path"))
    length = 1
    while length < gen_limit:
        paths = materialize(paths.withColumn("tail", F.element_at("path", -1)), "paths")
        # Ended paths, the largest group with one tail, stay out of the join.
        ended = paths.where(F.col("tail") == END_ID).select("state", "path")
        more = paths.select(F.col("state").alias("tail"), F.col("path").alias("more"))
        grown = lookup(paths.where(F.col("tail") != END_ID), more, ["tail"])
        longer = F.slice(F.concat("path", "more"), 1, gen_limit)
        paths = grown.select("state", longer.alias("path")).unionByName(ended)
        length *= 2
    return materialize(paths, "paths")


def beam_paths(model: BigramModel, beam: int, gen_limit: int = 50, bounded: bool = True) -> DataFrame:
    """``state, path, score``: the best hypothesis after each state.

    A row holds the open hypotheses of a state, at most ``beam``, and its best finished one. Each step
    continues the open ones with their followers and keeps the best; a finished hypothesis leaves the beam,
    which shrinks by one. The result is the finished hypothesis with the best score per word, or the best
    open one when a state has none. A hypothesis that ends in the very last step counts as open.

    After a step every open hypothesis ends in a word that follows some other, and with each further step in a
    word of a smaller or equal set, which holds its own followers. Steps are joins until that set's followers
    fit into ``BROADCAST_BYTES``; all later steps of a state are then one pass over its row.

    Branch and bound: no word adds more than the largest gain ``g`` in the table, so an open hypothesis with
    score ``s`` after ``n`` words ends at ``g + (s - n g) / gen_limit`` per word at best. A state whose
    finished one is better is decided, and takes no further steps.
    """
    beam = min(beam, model.types)
    gain = hypothesis_step(F.lit(0.0), F.col("p"))
    listed = top_successors(model, beam).groupBy("prev").agg(F.array_sort(F.collect_list(F.struct(F.col("next"), gain.alias("gain")))).alias("_next"))
    followers = materialize(listed.withColumnRenamed("prev", "_last"), "followers")
    most = followers.agg(F.max(F.array_max(F.transform("_next", lambda n: n["gain"])))).first()[0] or 0.0
    bound = most if bounded else None
    hypothesis = "struct<rank:double,path:array<int>,score:double,last:int>"
    table = states(model).select(
        F.col("prev").alias("state"),
        F.array(F.struct(F.lit(0.0), F.array().cast("array<int>"), F.lit(0.0), "prev").cast(hypothesis)).alias("live"),
        F.lit(beam).alias("room"),
        F.lit(None).cast(hypothesis).alias("best"),
    )
    decided, step = [], 0
    while step < gen_limit:
        step += 1
        table = materialize(_beam_step(table, followers, step, gen_limit, bound), "beam")
        decided.append(table.where(F.size("live") == 0).select("state", "best.path", "best.score"))
        table = table.where(F.size("live") > 0)
        reached = followers.select(F.explode("_next.next").alias("_last")).distinct()
        followers = materialize(followers.join(reached, "_last", "left_semi"), "followers")
        if followers.count() * (8 + 16 * beam) <= BROADCAST_BYTES:
            break
    if step < gen_limit:
        left = _walked(table, followers, beam, step, gen_limit, bound)
    else:
        best = F.coalesce("best", F.array_min(F.transform("live", _per_word)))
        left = table.select("state", best.alias("best")).select("state", "best.path", "best.score")
    best = reduce(DataFrame.unionByName, decided, left)
    return materialize(best.select("state", "path", (F.col("score") / F.size("path")).alias("score")), "best")


def _walked(table: DataFrame, followers: DataFrame, beam: int, done: int, gen_limit: int, most: float | None) -> DataFrame:
    """``state, path, score``: the steps after the first ``done``, for followers that fit into a worker."""
    listed = followers.select("_last", F.col("_next.next").alias("next"), F.col("_next.gain").alias("gain")).toArrow()
    words = listed["_last"].to_numpy()
    order = np.argsort(words, kind="stable")
    sizes = np.diff(_offsets(listed["next"].combine_chunks()))[order]
    held = np.arange(beam) < sizes[:, None]
    following, gains = np.zeros(held.shape, np.int32), np.full(held.shape, -np.inf)
    listed = listed.take(order)
    following[held], gains[held] = (listed[c].combine_chunks().flatten().to_numpy() for c in ("next", "gain"))
    shared = table.sparkSession.sparkContext.broadcast((words[order], following, gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, WALK_CELLS // beam**2)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield _walk(batch.slice(at, rows), *shared.value, done, gen_limit, most)

    live = F.array_sort(F.transform("live", lambda h: F.struct(h["path"], h["score"])))  # in order of their paths
    flat = table.select("state", "room", "best.path", "best.score", live.alias("_h")).select(
        "state", "room", "path", "score", F.flatten("_h.path").alias("paths"), F.col("_h.score").alias("scores")
    )
    return spread_small(flat, "state").mapInArrow(run, "state int, path array<int>, score double")


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def _rank(scores: np.ndarray) -> np.ndarray:
    """Scores that agree to ``RANK_DIGITS`` have one rank; the best is the smallest."""
    return np.floor(-scores * 10.0**RANK_DIGITS + 0.5)


def _walk(batch: pa.RecordBatch, words: np.ndarray, following: np.ndarray, gains: np.ndarray, done: int, gen_limit: int, most: float | None) -> pa.RecordBatch:
    """All further steps of some states, side by side.

    A state's hypotheses stand in order of their paths and followers in order of their ids, so candidates are in
    order of their paths, and a stable sort by rank breaks ties as the paths do.
    """
    beam, n = following.shape[1], batch.num_rows
    columns = dict(zip(batch.schema.names, batch.columns))
    sizes = np.diff(_offsets(columns["scores"]))
    held = np.arange(beam) < sizes[:, None]
    scores, paths = np.full((n, beam), -np.inf), np.zeros((n, beam, gen_limit), np.int32)
    scores[held] = columns["scores"].flatten().to_numpy()
    grown = np.zeros((held.sum(), gen_limit), np.int32)
    grown[:, :done] = columns["paths"].flatten().to_numpy().reshape(-1, done)
    paths[held] = grown
    room = columns["room"].to_numpy().copy()
    best = columns["score"].to_numpy(zero_copy_only=False).astype(float)  # NaN without a finished one
    lengths = np.where(np.isnan(best), 0, np.diff(_offsets(columns["path"])))
    best_path = np.zeros((n, gen_limit), np.int32)
    best_path[np.arange(gen_limit) < lengths[:, None]] = columns["path"].flatten().to_numpy()
    best_rank = np.where(lengths > 0, _rank(best / np.maximum(lengths, 1)), np.inf)
    at = np.arange(n)  # the rows that still go on; scores, paths and room are theirs

    def finish(rows: np.ndarray, slot: np.ndarray, rank: np.ndarray, step: int) -> None:
        """Hypotheses of ``step`` words become the best of their rows, where they are better."""
        mine = at[rows]
        better = rank < best_rank[mine]
        for i in np.flatnonzero(rank == best_rank[mine]):
            old = best_path[mine[i], : lengths[mine[i]]].tolist()
            better[i] = paths[rows[i], slot[i], :step].tolist() < old
        rows, slot, mine = rows[better], slot[better], mine[better]
        best[mine], best_rank[mine], lengths[mine] = scores[rows, slot], rank[better], step
        best_path[mine] = paths[rows, slot]

    for step in range(done + 1, gen_limit + 1):
        if not len(at):
            break
        last = np.searchsorted(words, paths[:, :, step - 2])
        last[last == len(words)] = 0  # empty places, whose score stays at minus infinity
        made = (scores[:, :, None] + gains[last]).reshape(len(at), -1)
        ranks = _rank(made)
        chosen = np.argsort(ranks, axis=1, kind="stable")[:, :beam]
        kept = (np.arange(beam) < room[:, None]) & np.isfinite(np.take_along_axis(ranks, chosen, 1))
        chosen = np.sort(np.where(kept, chosen, made.shape[1]), axis=1)
        kept = chosen < made.shape[1]
        chosen[~kept] = 0
        scores = np.where(kept, np.take_along_axis(made, chosen, 1), -np.inf)
        ranks = np.where(kept, np.take_along_axis(ranks, chosen, 1), np.inf)
        paths = np.take_along_axis(paths, (chosen // beam)[:, :, None], 1)
        paths[:, :, step - 1] = np.take_along_axis(following[last].reshape(len(at), -1), chosen, 1)
        per_word = _rank(scores / step)
        if step == gen_limit:
            none = np.flatnonzero(lengths[at] == 0)
            slot = per_word[none].argmin(1)
            finish(none, slot, per_word[none, slot], step)
            break
        ended = kept & (paths[:, :, step - 1] == END_ID)
        rows = np.flatnonzero(ended.any(1))
        slot = np.where(ended, per_word, np.inf)[rows].argmin(1)
        finish(rows, slot, per_word[rows, slot], step)
        room = room - ended.sum(1)
        scores[ended], ranks[ended] = -np.inf, np.inf
        going = (room > 0) & (kept & ~ended).any(1)
        if most is not None:
            first = scores[np.arange(len(at)), ranks.argmin(1)]
            going &= _rank(most + (first - step * most) / gen_limit) <= best_rank[at]
        scores, paths, room, at = scores[going], paths[going], room[going], at[going]
    spelled = pa.array(best_path[np.arange(gen_limit) < lengths[:, None]], pa.int32())
    offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    return pa.RecordBatch.from_arrays([columns["state"], pa.ListArray.from_arrays(offsets, spelled), pa.array(best)], names=["state", "path", "score"])


def _per_word(h: Column) -> Column:
    """The hypothesis with its rank by score per word."""
    return h.withField("rank", -F.round(h["score"] / F.size(h["path"]), RANK_DIGITS))


def _beam_step(table: DataFrame, followers: DataFrame, step: int, gen_limit: int, most: float | None) -> DataFrame:
    """One word more."""
    spread = table.select("state", "room", "best", F.explode_outer("live").alias("_h")).withColumn("_last", F.col("_h.last"))
    grown = F.transform(
        "_next",
        lambda n: F.struct(
            (-F.round(F.col("_h.score") + n["gain"], RANK_DIGITS)).alias("rank"),
            F.concat(F.col("_h.path"), F.array(n["next"])).alias("path"),
            (F.col("_h.score") + n["gain"]).alias("score"),
            n["next"].alias("last"),
        ),
    )
    grouped = spread.join(followers, "_last", "left").groupBy("state")
    kept = grouped.agg(F.first("room").alias("room"), F.first("best").alias("best"), F.flatten(F.collect_list(grown)).alias("_grown"))
    kept = kept.withColumn("_kept", F.slice(F.sort_array("_grown"), F.lit(1), F.greatest("room", F.lit(0))))
    if step == gen_limit:
        return kept.select("state", F.col("_kept").alias("live"), "room", "best")
    is_end = lambda h: h["last"] == END_ID
    ended = F.transform(F.filter("_kept", is_end), _per_word)
    kept = kept.withColumn("best", F.array_min(F.array_append(ended, F.col("best"))))
    kept = kept.withColumn("room", F.col("room") - F.size(ended)).withColumn("_open", F.filter("_kept", lambda h: ~is_end(h)))
    going = F.col("room") > 0
    if most is not None:
        reach = F.lit(most) + (F.get("_open", F.lit(0))["score"] - step * most) / gen_limit
        going &= F.col("best").isNull() | (-F.round(reach, RANK_DIGITS) <= F.col("best.rank"))
    nothing = F.filter("_open", lambda h: F.lit(False))
    return kept.select("state", F.when(going, F.col("_open")).otherwise(nothing).alias("live"), "room", "best")


def path_text(model: BigramModel, paths: DataFrame) -> DataFrame:
    """Add ``output``: the words of ``path`` before the end token."""
    words = paths.withColumn("_ids", until(F.col("path"), END_ID))
    named = look_up_elements(words, ["state"], "_ids", model.vocabulary.select("id", "tok"), None, "_toks")
    text = named.select("state", F.array_join("_toks", " ").alias("output"))
    return paths.join(text, "state")


def last_word(words: str) -> Column:
    return F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(BOS))


def asked_states(model: BigramModel, prompts: DataFrame, words: str = "toks") -> DataFrame:
    """``state``: the last words of the prompts that the model knows, and ``<UNK>`` for the others. Only
    their paths need to be spelled out."""
    asked = prompts.select(last_word(words).alias("tok")).distinct()
    vocabulary = model.vocabulary.select("tok", F.col("id").alias("state"))
    return vocabulary.where(F.col("state") == UNK_ID).unionByName(vocabulary.join(asked, "tok", "left_semi")).select("state").distinct()


def continue_prompts(model: BigramModel, prompts: DataFrame, paths: DataFrame, words: str = "toks") -> DataFrame:
    """Give each prompt the path of its last word; unknown words count as ``<UNK>``."""
    last = prompts.withColumn("_last", last_word(words))
    # One row per possible last word: state ids and prompts meet in the vocabulary, not line by line.
    by_word = model.vocabulary.select(F.col("tok").alias("_last"), F.col("id").alias("state")).join(paths, "state")
    by_word = materialize(by_word, "by_word")
    unknown = paths.where(F.col("state") == UNK_ID).select(*[F.col(c).alias(f"_unk_{c}") for c in paths.columns]).first()
    out = lookup(last, by_word, ["_last"]).drop("_last")
    for field in paths.schema.fields:
        value = F.lit(unknown[f"_unk_{field.name}"])
        out = out.withColumn(field.name, F.coalesce(field.name, value.cast(field.dataType)))
    return out
