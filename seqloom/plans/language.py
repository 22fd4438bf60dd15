"""Language-model queries: document lines and event sequences, scored and continued."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.text import BOS, END, tokens
from seqloom.operators import decode
from seqloom.operators import language_model as lm
from seqloom.operators.index import dense_index, following
from seqloom.operators.lookup import lookup, lookups
from seqloom.operators.report import in_input_order
from seqloom.plans import sql
from seqloom.plans.text import marked_lines
from seqloom.session import materialize
from seqloom.sources.tables import conversation_lines, document_lines, table

SUCCESSORS = 3
DISCOUNT = 0.3
BEAM = 3
GEN_LIMIT = 50
LOG_DIGITS = 6


def document_ids(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``lang, ids`` of each line, and the vocabulary."""
    lines = marked_lines(document_lines(spark, folder))
    vocabulary = lm.fit_words(lines, ["doc_id", "line_no"])
    return lm.encode(lines, ["lang"], vocabulary), vocabulary


def document_model(spark: SparkSession, folder: str) -> lm.BigramModel:
    return lm.train_encoded(*document_ids(spark, folder))


RUN_ROWS = 1 << 16  # events that one window sorts


def event_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event; minute, microsecond of the minute and event id order a user's events."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    minute = 60_000_000
    return table(spark, folder, "events").select(
        "user_id",
        F.floor(micros / minute).cast("int").alias("minute"),
        F.pmod(micros, F.lit(minute)).cast("int").alias("micro"),
        "event_id",
        F.col("event_type").alias("tok"),
    )


def event_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``user_id, minute, micro, place, prev, next`` of ``<s> events </s>``, one sequence per user.

    All events are numbered in order, and runs of numbers bound what a window holds: the events of one user,
    however many, spread over the tasks. ``place`` orders the pairs of all sequences.
    """
    events = dense_index(event_tokens(spark, folder), "user_id", "minute", "micro", "event_id")
    run = F.floor(F.col("row_index") / RUN_ROWS)
    after = following(events, "user_id", run, ["row_index"], "tok", first="opens")
    place = F.col("row_index") * 2
    ends = F.struct((F.col("micro") + 1).alias("micro"), (place + 1).alias("place"), F.col("tok").alias("prev"), F.coalesce("next", F.lit(END)).alias("next"))
    starts = F.when(F.col("opens"), F.struct(F.col("micro"), place.alias("place"), F.lit(BOS).alias("prev"), F.col("tok").alias("next")))
    pairs = after.select("user_id", "minute", F.explode(F.array_compact(F.array(ends, starts))).alias("p"))
    return pairs.select("user_id", "minute", "p.micro", "p.place", "p.prev", "p.next")


def event_model(pairs: DataFrame) -> lm.BigramModel:
    return lm.train(pairs, ("place",))


def stored_event_pairs(spark, folder):
    return materialize(event_pairs(spark, folder), "event_pairs")


def log_p() -> Column:
    """Probabilities are reported as logarithms: small ones keep their digits."""
    return F.round(F.ln("p"), LOG_DIGITS).alias("ln_p")


def bigram_report(model: lm.BigramModel) -> DataFrame:
    return lm.bigram_table(model).select("prev", "next", "n", log_p())


def lm_train(spark, folder):
    return bigram_report(document_model(spark, folder))


def events_lm_train(spark, folder):
    return bigram_report(event_model(stored_event_pairs(spark, folder)))


def events_next(spark, folder):
    return event_pairs(spark, folder).select("user_id", "minute", "micro", "prev", "next")


def rounded_losses(rows: DataFrame) -> DataFrame:
    for name in ("loss", "ppl", "token_loss", "token_ppl"):
        if name in rows.columns:
            rows = rows.withColumn(name, F.round(name, 4))
    return rows


def sentence_ppl(spark, folder):
    model = document_model(spark, folder)
    keys = ["conv_id", "turn", "line_no"]
    pairs = lm.pair_rows(marked_lines(conversation_lines(spark, folder)), keys)
    return rounded_losses(lm.sentence_loss(model, pairs, keys))


def document_losses(spark, folder):
    encoded, vocabulary = document_ids(spark, folder)
    lines = materialize(encoded, "encoded")
    model = lm.train_encoded(lines, vocabulary)
    shared = lines.withColumn("share", 1 / (F.size("ids") - 1))
    return lm.corpus_loss(model, lm.pair_rows(shared, ["lang", "share"], "ids"), ["lang"], F.col("share"))


def corpus_ppl(spark, folder):
    return rounded_losses(document_losses(spark, folder)).select("lang", "n_tok", "loss", "ppl")


def corpus_ppl_weighted(spark, folder):
    model = document_model(spark, folder)
    lines = marked_lines(conversation_lines(spark, folder)).withColumn("share", 1 / (F.size("toks") - 1))
    losses = lm.corpus_loss(model, lm.pair_rows(lines, ["role", "share"]), ["role"], F.col("share"))
    return rounded_losses(losses).select("role", "n_tok", "token_loss", "token_ppl")


def events_sentence_ppl(spark, folder):
    pairs = stored_event_pairs(spark, folder)
    return rounded_losses(lm.sentence_loss(event_model(pairs), pairs, ["user_id"]))


def events_corpus_ppl(spark, folder):
    pairs = stored_event_pairs(spark, folder)
    lengths = materialize(pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("len")), "lengths")
    shared = lookup(pairs, lengths, ["user_id"], how="inner")
    # The opening pair's target is the user's first event: sequences are grouped by how they begin.
    opening = pairs.where(F.col("prev") == BOS).select("user_id", F.col("next").alias("opening"))
    grouped = lookup(shared, materialize(opening.join(lengths, "user_id"), "openings"), ["user_id", "len"])
    return rounded_losses(lm.corpus_loss(event_model(pairs), grouped, ["opening"], 1 / F.col("len")))


def named_successors(model: lm.BigramModel, best: DataFrame) -> DataFrame:
    names = [model.vocabulary.select(F.col("id").alias(s), F.col("tok").alias(f"{s}_tok")) for s in ("prev", "next")]
    best = lookups(materialize(best, "successors"), [(names[0], ["prev"]), (names[1], ["next"])])
    return best.select(
        F.col("prev_tok").alias("prev"), "rank", F.col("next_tok").alias("next"), log_p()
    )


def topk_successors(spark, folder):
    model = document_model(spark, folder)
    return named_successors(model, decode.top_successors(model, SUCCESSORS))


def events_topk_successors(spark, folder):
    model = event_model(stored_event_pairs(spark, folder))
    return named_successors(model, decode.top_successors(model, SUCCESSORS))


def brevity_adjust(spark, folder):
    model = document_model(spark, folder)
    return named_successors(model, decode.top_successors(model, SUCCESSORS, DISCOUNT))


def prompts(spark, folder):
    lines = conversation_lines(spark, folder).withColumn("toks", tokens("text"))
    return lines.select("conv_id", "turn", "line_no", "toks")


def generate_greedy(spark, folder):
    model = document_model(spark, folder)
    return answers(model, prompts(spark, folder), decode.greedy_paths(model, GEN_LIMIT))


def answers(model: lm.BigramModel, asked: DataFrame, paths: DataFrame) -> DataFrame:
    """The continuation of each prompt; only the paths of words that prompts end in are spelled."""
    wanted = paths.join(decode.asked_states(model, asked), "state", "left_semi")
    spelled = decode.path_text(model, materialize(wanted, "wanted")).select("state", "output")
    return decode.continue_prompts(model, asked, spelled).select("conv_id", "turn", "line_no", "output")


def beam_decode(spark, folder):
    """Best continuation after every word of the document model."""
    model = document_model(spark, folder)
    return beam_report(model)


def beam_report(model: lm.BigramModel) -> DataFrame:
    best = decode.path_text(model, decode.beam_paths(model, BEAM, GEN_LIMIT))
    names = model.vocabulary.select(F.col("id").alias("state"), "tok")
    return best.join(names, "state").select("tok", "output", F.round("score", 6).alias("score"))


def events_beam_decode(spark, folder):
    return beam_report(event_model(stored_event_pairs(spark, folder)))


def decode_in_order(spark, folder):
    model = document_model(spark, folder)
    keys = ["conv_id", "turn", "line_no"]
    done = answers(model, prompts(spark, folder), decode.beam_paths(model, BEAM, GEN_LIMIT))
    return in_input_order(conversation_lines(spark, folder).select(*keys, "text"), done, keys)


QUERIES = {
    f.__name__: f
    for f in (
        lm_train, events_lm_train, events_next, sentence_ppl, corpus_ppl, corpus_ppl_weighted, events_sentence_ppl,
        events_corpus_ppl, topk_successors, events_topk_successors, brevity_adjust, generate_greedy, beam_decode,
        events_beam_decode, decode_in_order,
    )
}

_W = sql.marked(sql.words("text"))
_DOC = f"""WITH {sql.DOC_LINES}, {sql.pairs("prs", "doc_lines", "doc_id, line_no, lang", _W)},
{sql.bigram_model("prs", "doc_id, line_no, pos")}"""
_EVENT_PAIRS = """
ordered AS (
  SELECT user_id, event_type AS tok, ts, CAST(floor(epoch_us(ts) / 60000000) AS INT) AS minute,
    CAST(epoch_us(ts) % 60000000 AS INT) AS micro,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
prs AS (
  SELECT user_id, minute, CAST(micro + 1 AS INT) AS micro, nth, tok AS prev,
    coalesce(lead(tok) OVER (PARTITION BY user_id ORDER BY nth), '</s>') AS next FROM ordered
  UNION ALL SELECT user_id, minute, micro, 0, '<s>', tok FROM ordered WHERE nth = 1)"""
_EVENTS = f"WITH {_EVENT_PAIRS}, {sql.bigram_model('prs', 'user_id, nth')}"

_TABLE = f"""
SELECT a.tok AS prev, b.tok AS next, bi.n, round(ln({sql.probability("bi.n", "n_prev", "n_next")}), {LOG_DIGITS}) AS ln_p
FROM bi JOIN before USING (prev) JOIN after USING (next) JOIN voc a ON a.id = bi.prev JOIN voc b ON b.id = bi.next, size"""


def _scored(source: str, keys: str) -> str:
    """CTE scored(keys, nll) for pairs of words."""
    return f"""
ided AS (
  SELECT {keys}, coalesce(a.id, 0) AS prev, coalesce(b.id, 0) AS next
  FROM {source} p LEFT JOIN voc a ON p.prev = a.tok LEFT JOIN voc b ON p.next = b.tok),
scored AS (
  SELECT {keys}, -ln({sql.probability("n", "n_prev", "n_next")}) AS nll
  FROM ided LEFT JOIN bi USING (prev, next) LEFT JOIN before USING (prev) LEFT JOIN after USING (next), size),"""


_TALK_KEYS = "conv_id, turn, line_no, role"
_TALK_SCORED = f"""{_DOC}, {sql.TALK_LINES}, {sql.pairs("talk", "talk_lines", _TALK_KEYS, _W)},
{_scored("talk", _TALK_KEYS)}
sentences AS (SELECT {_TALK_KEYS}, count(*) AS n_tok, avg(nll) AS loss, sum(nll) AS total FROM scored GROUP BY ALL)"""


def _successors(k: int, discount: float = 0.0) -> str:
    """CTE succ(prev, next, p, rank): every state beside its seen followers and the most frequent words."""
    p = sql.probability("n", "n_prev", "n_next")
    return f"""
short AS (
  SELECT id AS next FROM voc LEFT JOIN after ON id = next WHERE tok NOT IN ('<s>', '<EOS>', '{{*}}')
  ORDER BY coalesce(n_next, 0) DESC, id LIMIT {k + 1}),
cand AS (
  SELECT prev, next FROM bi
  UNION SELECT voc.id, short.next FROM voc, short WHERE tok NOT IN ('<EOS>', '{{*}}', '</s>')),
probs AS (
  SELECT prev, next, ({p}) * CASE WHEN next = 4 THEN {1.0 - discount!r} ELSE 1.0 END AS p
  FROM cand LEFT JOIN bi USING (prev, next) LEFT JOIN before USING (prev) LEFT JOIN after USING (next), size),
succ AS (
  SELECT prev, next, p, row_number() OVER (PARTITION BY prev ORDER BY round(ln(p), 9) DESC, next) AS rank
  FROM probs QUALIFY rank <= {k})"""


_NAMED = f"""
SELECT a.tok AS prev, CAST(rank AS INT) AS rank, b.tok AS next, round(ln(p), {LOG_DIGITS}) AS ln_p
FROM succ JOIN voc a ON a.id = prev JOIN voc b ON b.id = next"""

# All targets of all states: affordable for the few event types, and free of the short list.
_EVERY = f"""
cand AS (
  SELECT a.id AS prev, b.id AS next FROM voc a, voc b
  WHERE a.tok NOT IN ('<EOS>', '{{*}}', '</s>') AND b.tok NOT IN ('<s>', '<EOS>', '{{*}}')),
probs AS (
  SELECT prev, next, {sql.probability("n", "n_prev", "n_next")} AS p
  FROM cand LEFT JOIN bi USING (prev, next) LEFT JOIN before USING (prev) LEFT JOIN after USING (next), size),
succ AS (
  SELECT prev, next, p, row_number() OVER (PARTITION BY prev ORDER BY round(ln(p), 9) DESC, next) AS rank
  FROM probs QUALIFY rank <= {SUCCESSORS})"""


def _path_text(array: str) -> str:
    """Words of an id list before the first end id."""
    return f"""
spread AS (
  SELECT state, unnest(range(len(w))) AS pos, unnest(w) AS id FROM (
    SELECT state, CASE WHEN list_contains({array}, 4) THEN {array}[1:list_position({array}, 4) - 1] ELSE {array} END AS w
    FROM best)),
texts AS (
  SELECT state, coalesce(string_agg(tok, ' ' ORDER BY pos), '') AS output
  FROM best LEFT JOIN spread USING (state) LEFT JOIN voc USING (id) GROUP BY state)"""


def _beam(successors: str, model: str) -> str:
    """The beam search as a recursive statement, step by step to the limit, without a bound."""
    return f"""WITH RECURSIVE {model[len("WITH ") :]}, {successors},
follow AS MATERIALIZED (SELECT prev, next, ln(p + 1e-6) AS gain FROM succ),
walk AS (
  SELECT DISTINCT prev AS state, prev AS last, 0.0::DOUBLE AS score, []::INT[] AS path, {BEAM} AS room, 0 AS step FROM succ
  UNION ALL
  SELECT * FROM (
    SELECT state, next AS last, score + gain AS score, list_append(path, next) AS path, room_left AS room, step + 1 AS step
    FROM (
      SELECT *, room - CAST(sum(CASE WHEN last = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY state) AS INT) AS room_left FROM walk)
    JOIN follow ON last = prev WHERE last <> 4 AND room_left > 0 AND step < {GEN_LIMIT})
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY round(score, 9) DESC, path) <= room),
pool AS (
  SELECT state, path, score, CASE WHEN step < {GEN_LIMIT} THEN 0 ELSE 1 END AS open
  FROM walk WHERE step = {GEN_LIMIT} OR last = 4),
best AS (
  SELECT state, path, score / len(path) AS score FROM pool
  QUALIFY row_number() OVER (PARTITION BY state ORDER BY open, round(score / len(path), 9) DESC, path) = 1),
{_path_text("path")}"""


_BEAM_ROWS = """
SELECT tok, output, round(score, 6) AS score FROM best JOIN texts USING (state) JOIN voc ON voc.id = state"""
_BEAM_DOC = _beam(_successors(BEAM), _DOC)

_LAST = f"""
asked AS (
  SELECT conv_id, turn, line_no, text, coalesce(w[-1], '<s>') AS last
  FROM (SELECT *, {sql.words("text")} AS w FROM talk_lines)),
answered AS (
  SELECT conv_id, turn, line_no, text, texts.output
  FROM asked LEFT JOIN voc ON tok = last JOIN texts ON state = coalesce(voc.id, 0))"""

SQL = {
    "lm_train": _DOC + _TABLE,
    "events_lm_train": _EVENTS + _TABLE,
    "events_next": f"WITH {_EVENT_PAIRS} SELECT user_id, minute, micro, prev, next FROM prs",
    "sentence_ppl": f"""{_TALK_SCORED}
SELECT conv_id, turn, line_no, n_tok, round(loss, 4) AS loss, round(exp(loss), 4) AS ppl FROM sentences""",
    "corpus_ppl": f"""{_DOC}, {_scored("prs", "doc_id, line_no, lang")}
sentences AS (SELECT doc_id, line_no, lang, count(*) AS n_tok, avg(nll) AS loss FROM scored GROUP BY ALL)
SELECT lang, CAST(sum(n_tok) AS BIGINT) AS n_tok, round(avg(loss), 4) AS loss, round(exp(avg(loss)), 4) AS ppl
FROM sentences GROUP BY lang""",
    "corpus_ppl_weighted": f"""{_TALK_SCORED}
SELECT role, CAST(sum(n_tok) AS BIGINT) AS n_tok, round(sum(total) / sum(n_tok), 4) AS token_loss,
  round(exp(sum(total) / sum(n_tok)), 4) AS token_ppl FROM sentences GROUP BY role""",
    "events_sentence_ppl": f"""{_EVENTS}, {_scored("prs", "user_id")}
sentences AS (SELECT user_id, count(*) AS n_tok, avg(nll) AS loss FROM scored GROUP BY ALL)
SELECT user_id, n_tok, round(loss, 4) AS loss, round(exp(loss), 4) AS ppl FROM sentences""",
    "events_corpus_ppl": f"""{_EVENTS}, {_scored("prs", "user_id")}
sentences AS (SELECT user_id, count(*) AS n_tok, avg(nll) AS loss, sum(nll) AS total FROM scored GROUP BY ALL)
SELECT tok AS opening, CAST(sum(n_tok) AS BIGINT) AS n_tok, round(avg(loss), 4) AS loss, round(exp(avg(loss)), 4) AS ppl,
  round(sum(total) / sum(n_tok), 4) AS token_loss, round(exp(sum(total) / sum(n_tok)), 4) AS token_ppl
FROM sentences JOIN ordered USING (user_id) WHERE nth = 1 GROUP BY tok""",
    "topk_successors": f"{_DOC}, {_successors(SUCCESSORS)} {_NAMED}",
    "events_topk_successors": f"{_EVENTS}, {_EVERY} {_NAMED}",
    "brevity_adjust": f"{_DOC}, {_successors(SUCCESSORS, DISCOUNT)} {_NAMED}",
    "generate_greedy": f"""WITH RECURSIVE {_DOC[len("WITH "):]}, {sql.TALK_LINES}, {_successors(1)},
walk AS (
  SELECT prev AS state, next AS last, 1 AS len, [next] AS path FROM succ
  UNION ALL
  SELECT state, next, len + 1, list_append(path, next) FROM walk JOIN succ ON last = prev
  WHERE last <> 4 AND len < {GEN_LIMIT}),
best AS (SELECT state, arg_max(path, len) AS path FROM walk GROUP BY state),
{_path_text("path")}, {_LAST}
SELECT conv_id, turn, line_no, output FROM answered""",
    "beam_decode": _BEAM_DOC + _BEAM_ROWS,
    "events_beam_decode": _beam(_EVERY.replace(f"rank <= {SUCCESSORS}", f"rank <= {BEAM}"), _EVENTS) + _BEAM_ROWS,
    "decode_in_order": f"{_BEAM_DOC}, {sql.TALK_LINES}, {_LAST} SELECT conv_id, turn, line_no, text, output FROM answered",
}
