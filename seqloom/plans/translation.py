"""Queries on parallel text: lexicons, expectation maximisation, alignment, translation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.text import TRANSLATION_MARKERS, tokens
from seqloom.operators import batching, lexicon, model_store, report, translation
from seqloom.operators import language_model as lm
from seqloom.operators.lookup import lookup, lookups
from seqloom.operators.softmax import group_softmax
from seqloom.operators.vocabulary import encode_tokens
from seqloom.plans import sql
from seqloom.plans.text import id_text, marked_lines
from seqloom.session import materialize, scratch_path, spread_small
from seqloom.sources.corpus import parse_lexicon
from seqloom.sources.tables import conversation_lines, conversations, document_lines, turn_pairs

KEYS = ["conv_id", "turn"]
EPOCHS = 10
SHORT, FREQUENT = 5, 10  # targets of a source word, and of the whole model, that are rescored
BATCH = 64
PAD_ID = TRANSLATION_MARKERS.index("{*}")
MIXTURES = {"ln_even": 0.0, "ln_lean": 1.5}  # column and weight before the sigmoid
FIRST_LOSS = 150.0  # the loss that the first epoch is compared with


def scan_parallel(spark, folder):
    return turn_pairs(spark, folder)


def training_text(spark, folder) -> translation.ParallelText:
    return translation.encode_parallel(turn_pairs(spark, folder), KEYS)


def lexicon_lines(pairs: DataFrame) -> DataFrame:
    """``text`` with ``trg src prob``: in how many pairs two words meet, as a share of the source word.

    The lines come from the distinct words of each different pair, as numbers, dealt out and counted like the cells of
    a training step.
    """
    words = [F.array_sort(F.array_distinct(tokens(side))).alias(side) for side in ("src", "trg")]
    once = translation.distinct_pairs(pairs.select(*words))
    numbered, names = translation.number_words(once)
    counts = translation.meetings(translation.blocks(numbered))
    totals = materialize(counts.groupBy("s").agg(F.sum("n").alias("total")), "totals")
    sources = totals.join(names.select(F.col("id").alias("s"), F.col("tok").alias("src")), "s")
    targets = names.select(F.col("id").alias("t"), F.col("tok").alias("trg"))
    named = lookups(spread_small(counts, "s", "t"), [(materialize(sources, "sources"), ["s"]), (targets, ["t"])], how="inner")
    prob = (F.col("n") / F.col("total")).cast("string")  # as many digits as the number needs
    return named.select(F.concat_ws(" ", "trg", "src", prob).alias("text"))


def scan_lexicon(spark, folder):
    return parse_lexicon(lexicon_lines(turn_pairs(spark, folder)), [])


def fitted_lexicon(spark, folder, text: translation.ParallelText) -> DataFrame:
    """Two editions, from the users' replies and from the assistant's answers; an entry of the later one wins."""
    editions = [turn_pairs(spark, folder, "assistant", "user"), turn_pairs(spark, folder)]
    lines = [lexicon_lines(pairs).withColumn("edition", F.lit(i)) for i, pairs in enumerate(editions)]
    rows = parse_lexicon(lines[0].unionByName(lines[1]), ["edition"])
    return lexicon.fit_lexicon(rows, text.src_vocabulary, text.trg_vocabulary, F.col("edition"))


def lexicon_fit(spark, folder):
    fitted = fitted_lexicon(spark, folder, training_text(spark, folder))
    return fitted.select("src_id", "trg_id", F.round("prob", 8).alias("prob"), "clipped")


def lexicon_lookup(spark, folder):
    """For every word of every turn: how many targets its distribution has, and the mass of ``<UNK>``."""
    text = training_text(spark, folder)
    whole = materialize(
        lexicon.compile_lexicon(fitted_lexicon(spark, folder, text), text.src_vocabulary)
        .groupBy("src_id")
        .agg(
            F.count(F.lit(1)).alias("n_targets"),
            F.sum(F.when(F.col("trg_id") == translation.UNK_ID, F.col("prob")).otherwise(0.0)).alias("unk_prob"),
        ),
        "distributions",
    )
    words = conversations(spark, folder).select(*KEYS, F.posexplode(tokens("text")).alias("pos", "tok"))
    encoded = encode_tokens(words, text.src_vocabulary).withColumnRenamed("id", "src_id")
    sized = lookup(encoded, whole, ["src_id"])
    return sized.select(*KEYS, "pos", "tok", "n_targets", F.round("unk_prob", 8).alias("unk_prob"))


def named_lexicon(table_: DataFrame, text: translation.ParallelText) -> DataFrame:
    named = report.alignment_names(table_, text.src_vocabulary, text.trg_vocabulary)
    return named.select("src", "trg", F.round(F.ln("p"), 6).alias("ln_p"))


def ibm1_lexicon(spark, folder):
    text = training_text(spark, folder)
    trained, _ = translation.train_lexicon(text, KEYS, EPOCHS)
    return named_lexicon(trained, text)


def ibm1_resume(spark, folder):
    """Each epoch is a run of its own: it rebuilds the last snapshot from disk, makes one step and saves the next."""
    text = training_text(spark, folder)
    path = scratch_path(spark, "ibm1")
    dealt = translation.blocks(translation.distinct_pairs(text.pairs))
    for epoch in range(1, EPOCHS + 1):
        before = None if epoch == 1 else model_store.load(spark, path).lexicon
        after, _ = translation.em_step(dealt, before, translation.uniform(text))
        model_store.save(model_store.TranslationModel(after, text.src_vocabulary, text.trg_vocabulary), path, epoch)
    saved = model_store.load(spark, path)
    return named_lexicon(saved.lexicon, saved)


def aligned_ids(spark, folder) -> tuple[translation.ParallelText, DataFrame]:
    text = training_text(spark, folder)
    trained, _ = translation.train_lexicon(text, KEYS, EPOCHS)
    return text, translation.align(report.cut_targets(text.pairs, translation.EOS_ID), KEYS, trained)


def alignment_long(spark, folder):
    text, aligned = aligned_ids(spark, folder)
    rows = report.alignment_names(aligned, text.src_vocabulary, text.trg_vocabulary)
    return rows.select(*KEYS, "src_pos", "src", "trg_pos", "trg", F.round("weight", 6).alias("weight"))


def alignment_matrix(spark, folder):
    """Weights in target order for each source position; ``alignment_header`` has the target words."""
    text, aligned = aligned_ids(spark, folder)
    rows = report.alignment_matrix(aligned, KEYS, ["s"])
    names = text.src_vocabulary.select(F.col("id").alias("s"), F.col("tok").alias("src"))
    return lookup(rows, names, ["s"]).select(*KEYS, "src_pos", "src", "weights")


def alignment_header(spark, folder):
    """The target words of each pair, up to its first end marker, over the columns of its matrix."""
    text = training_text(spark, folder)
    cut = report.cut_targets(text.pairs, translation.EOS_ID)
    return report.alignment_header(cut, KEYS, text.trg_vocabulary)


def alignment_held_out(spark, folder):
    """Replies to the assistant, aligned with a lexicon that never saw them: for each target position how many
    source positions it has, how many of them were never seen with it, the sum of weights, and the largest."""
    text = training_text(spark, folder)
    trained, _ = translation.train_lexicon(text, KEYS, EPOCHS)
    replies = turn_pairs(spark, folder, "assistant", "user")
    dev = translation.encode_parallel(replies, KEYS, vocabularies=(text.src_vocabulary, text.trg_vocabulary))
    rows = translation.align(dev.pairs, KEYS, trained).groupBy(*KEYS, "trg_pos")
    return rows.agg(
        F.count(F.lit(1)).alias("n_src"),
        F.count_if(F.col("p").isNull()).alias("n_unseen"),
        F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.max("weight"), 6).alias("largest"),
    )


def glossed(spark, folder) -> DataFrame:
    """Every user turn, answered or not, word by word."""
    text = training_text(spark, folder)
    trained, _ = translation.train_lexicon(text, KEYS, EPOCHS)
    asked = conversations(spark, folder).where(F.col("role") == "user").select(*KEYS, "text")
    return translation.gloss(asked, KEYS, text, trained)


def translate_gloss(spark, folder):
    return glossed(spark, folder)


def sample_report(spark, folder):
    pairs = turn_pairs(spark, folder)
    return report.sample_report(pairs.select(*KEYS, "src"), glossed(spark, folder), pairs.select(*KEYS, "trg"), KEYS)


def lexicon_rescore(spark, folder):
    """Target words for each pair's source, scored by frequency and rescored with the trained lexicon.

    Candidates are the likeliest targets of each source word, ``<UNK>`` for the rest, and the most frequent
    targets of all, whether the pair holds them or not. Attention is the share of each word in its sentence.
    """
    text = training_text(spark, folder)
    trained, _ = translation.train_lexicon(text, KEYS, EPOCHS)
    table_ = lexicon.shortlist(trained.select(F.col("s").alias("src_id"), F.col("t").alias("trg_id"), F.col("p").alias("prob")), SHORT)
    once = translation.distinct_pairs(text.pairs)
    attention = once.select("pair", F.size("src").alias("len"), F.explode("src").alias("src_id")).select(
        "pair", "src_id", (F.lit(1.0) / F.col("len")).alias("weight")
    )
    counts = text.pairs.select(F.explode("trg").alias("t")).groupBy(F.col("t").alias("trg_id")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = [r["trg_id"] for r in counts.orderBy(F.desc("n"), "trg_id").limit(FREQUENT).collect()]
    mixed = materialize(lexicon.mix_lexicon(attention, table_, ["pair"]), "mixed")
    scores = lookup(lexicon.candidates(mixed, frequent, ["pair"]), counts, ["trg_id"])
    scores = scores.withColumn("score", F.ln((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total))))
    scores = group_softmax(materialize(scores, "scores"), ["pair"], "score", "p")
    done = lexicon.rescore(materialize(scores, "scores"), ["pair"], weight=0.5)
    names = text.trg_vocabulary.select(F.col("id").alias("trg_id"), F.col("tok").alias("trg"))
    named = lookup(done, names, ["trg_id"])
    members = translation.pair_members(text.pairs, once, KEYS)
    rounded = [F.round(c, 6).alias(c) for c in ("mixed", "bias", "p_bias", "linear")]
    return named.join(members, "pair").select(*KEYS, "trg", *rounded)


def next_word_shares(lines: DataFrame) -> DataFrame:
    """``prev, next, p``: how often a word follows another, as a share of what follows that one.

    The counted pairs lie in order in each file: neighbours share words, so the table and its shuffles compress well.
    """
    counted = lm.pair_rows(marked_lines(lines), []).groupBy("prev", "next").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counted.sortWithinPartitions("prev", "next"), "following")
    totals = materialize(counts.groupBy("prev").agg(F.sum("n").alias("total")), "totals")
    return lookup(counts, totals, ["prev"]).select("prev", "next", (F.col("n") / F.col("total")).alias("p"))


def interpolate_scores(spark, folder):
    """The next words of documents and of conversations in one table, mixed half and half and four to one."""
    sides = next_word_shares(document_lines(spark, folder)), next_word_shares(conversation_lines(spark, folder))
    merged = lexicon.merge_distributions(*sides, ["prev", "next"], MIXTURES)
    return merged.select("prev", "next", *[F.round(F.ln(name), 6).alias(name) for name in MIXTURES])


def epoch_history(spark, folder):
    """Loss of each epoch beside the one before; held out are the user's replies to the assistant."""
    text = training_text(spark, folder)
    replies = turn_pairs(spark, folder, "assistant", "user")
    dev = translation.encode_parallel(replies, KEYS, vocabularies=(text.src_vocabulary, text.trg_vocabulary))
    _, history = translation.train_lexicon(text, KEYS, EPOCHS, dev.pairs)
    rows = translation.history_table(spark, history, FIRST_LOSS)
    rounded = [F.round(c, 5).alias(c) for c in ("loss", "previous", "dev_loss")]
    return rows.select("epoch", *rounded, (F.col("loss") < F.col("previous")).alias("improved"))


def pad_batches(spark, folder):
    """Pairs in batches by source length; each side is padded to its own longest."""
    text = training_text(spark, folder)
    batches = batching.length_batches(text.pairs.withColumn("n", F.size("src")), "n", KEYS, BATCH)
    padded = batching.pad_batches(batches, {"src": PAD_ID, "trg": PAD_ID})
    return id_text(id_text(padded, "src"), "trg").select("batch_id", *KEYS, "src", "trg")


QUERIES = {
    f.__name__: f
    for f in (
        scan_parallel, scan_lexicon, lexicon_fit, lexicon_lookup, ibm1_lexicon, ibm1_resume, alignment_long,
        alignment_matrix, alignment_header, alignment_held_out, translate_gloss, sample_report, lexicon_rescore,
        interpolate_scores, epoch_history, pad_batches,
    )
}


def _pairs(name: str, first: str, second: str) -> str:
    return f"""
{name} AS (
  SELECT u.conv_id, u.turn, u.text AS src, a.text AS trg FROM conversations u JOIN conversations a
  ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = '{first}' AND a.role = '{second}')"""


_PAIRS = _pairs("prs", "user", "assistant")
_ORDER = "conv_id, turn, pos"
_EOS_SRC, _EOS_TRG = (sql.with_eos(sql.words(side)) for side in ("src", "trg"))
_FIT = f"""WITH {_PAIRS},
{sql.spread("src_tokens", "prs", "conv_id, turn", _EOS_SRC)},
{sql.spread("trg_tokens", "prs", "conv_id, turn", _EOS_TRG)},
{sql.vocabulary("sv", "src_tokens", _ORDER, sql.TRANSLATION)},
{sql.vocabulary("tv", "trg_tokens", _ORDER, sql.TRANSLATION)},
es AS (SELECT conv_id, turn, pos, coalesce(id, 0) AS s FROM src_tokens LEFT JOIN sv USING (tok)),
et AS (SELECT conv_id, turn, pos, coalesce(id, 0) AS t FROM trg_tokens LEFT JOIN tv USING (tok))"""


def _cells(name: str, s: str, t: str) -> str:
    return f"""
{name} AS MATERIALIZED (
  SELECT a.conv_id, a.turn, len, s, n_s, t, n_t
  FROM (SELECT conv_id, turn, s, count(*) AS n_s FROM {s} GROUP BY ALL) a
  JOIN (SELECT conv_id, turn, t, count(*) AS n_t FROM {t} GROUP BY ALL) b USING (conv_id, turn)
  JOIN (SELECT conv_id, turn, count(*) AS len FROM {s} GROUP BY ALL) c USING (conv_id, turn))"""


def _steps(epochs: int) -> str:
    """The rounds of expectation maximisation, one after the other."""
    out = [f"""{_FIT}, {_cells("cells", "es", "et")},
lex0 AS (SELECT DISTINCT s, t, 1.0 / (SELECT count(*) - 1 FROM tv) AS p FROM cells)"""]
    for k in range(1, epochs + 1):
        out.append(f"""
post{k} AS MATERIALIZED (
  SELECT s, t, n_t, n_s * p AS w, sum(n_s * p) OVER (PARTITION BY conv_id, turn, t) AS denom, len
  FROM cells JOIN lex{k - 1} USING (s, t)),
sums{k} AS (SELECT s, t, sum(n_t * w / denom) AS mass FROM post{k} GROUP BY s, t),
lex{k} AS MATERIALIZED (SELECT s, t, mass / sum(mass) OVER (PARTITION BY s) AS p FROM sums{k})""")
    return ",".join(out)


_EM = _steps(EPOCHS)
_LEX = f"lex{EPOCHS}"
_IBM1 = f"""{_EM} SELECT sv.tok AS src, tv.tok AS trg, round(ln(p), 6) AS ln_p
FROM {_LEX} JOIN sv ON sv.id = s JOIN tv ON tv.id = t"""
_ALIGN = f"""{_EM},
aligned AS (
  SELECT conv_id, turn, es.pos AS src_pos, s, et.pos AS trg_pos, t,
    p / sum(p) OVER (PARTITION BY conv_id, turn, et.pos) AS weight
  FROM es JOIN et USING (conv_id, turn) JOIN {_LEX} USING (s, t)),
named AS (
  SELECT conv_id, turn, src_pos, sv.tok AS src, trg_pos, tv.tok AS trg, weight
  FROM aligned JOIN sv ON sv.id = s JOIN tv ON tv.id = t)"""
# A word <EOS> of a text is the marker: what follows it is cut.
_CUT = """
ends AS (SELECT conv_id, turn, min(pos) AS stop FROM et WHERE t = 1 GROUP BY ALL),
cut_trg AS (SELECT conv_id, turn, pos, t FROM et JOIN ends USING (conv_id, turn) WHERE pos <= stop)"""
_GLOSS = f"""{_EM},
best AS (
  SELECT s, t FROM {_LEX} WHERE t <> 1
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(ln(p), 9) DESC, t) = 1),
asked AS (
  SELECT conv_id, turn, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS tok
  FROM (SELECT conv_id, turn, {sql.words("text")} AS w FROM conversations WHERE role = 'user')),
gloss AS (
  SELECT conv_id, turn, string_agg(coalesce(tv.tok, '<UNK>'), ' ' ORDER BY pos) AS output
  FROM asked LEFT JOIN sv ON sv.tok = asked.tok LEFT JOIN best ON best.s = coalesce(sv.id, 0) LEFT JOIN tv ON tv.id = best.t
  GROUP BY conv_id, turn)"""


def _lexicon(name: str, source: str) -> str:
    """CTE name(trg, src, prob): the lines of a lexicon counted from pairs."""
    return f"""
{name} AS (
  SELECT trg, src, n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE) AS prob FROM (
    SELECT src, trg, count(*) AS n
    FROM (SELECT DISTINCT conv_id, turn, unnest({sql.words("src")}) AS src FROM {source}) a
    JOIN (SELECT DISTINCT conv_id, turn, unnest({sql.words("trg")}) AS trg FROM {source}) b USING (conv_id, turn) GROUP BY ALL))"""


_FITTED = f"""{_FIT}, {_pairs("replies", "assistant", "user")}, {_lexicon("early", "replies")}, {_lexicon("late", "prs")},
rows_ AS (
  SELECT trg, src, prob FROM (SELECT *, 0 AS edition FROM early UNION ALL SELECT *, 1 FROM late)
  QUALIFY row_number() OVER (PARTITION BY src, trg ORDER BY edition DESC) = 1),
known AS (
  SELECT sv.id AS src_id, tv.id AS trg_id, prob FROM rows_ JOIN sv ON sv.tok = src JOIN tv ON tv.tok = trg),
rest AS (SELECT src_id, 1.0 - sum(prob) AS rest FROM known GROUP BY src_id),
fitted AS (
  SELECT src_id, trg_id, prob, false AS clipped FROM known WHERE trg_id <> 0
  UNION ALL SELECT src_id, CAST(0 AS INT), greatest(rest, 0.0), rest < -1e-9 FROM rest)"""
_DEV = f"""{_pairs("replies", "assistant", "user")},
{sql.spread("dev_src", "replies", "conv_id, turn", _EOS_SRC)},
{sql.spread("dev_trg", "replies", "conv_id, turn", _EOS_TRG)},
ds AS (SELECT conv_id, turn, pos, coalesce(id, 0) AS s FROM dev_src LEFT JOIN sv USING (tok)),
dt AS (SELECT conv_id, turn, pos, coalesce(id, 0) AS t FROM dev_trg LEFT JOIN tv USING (tok)),
{_cells("dev_cells", "ds", "dt")}"""


def _history() -> str:
    out = [f"{_EM}, {_DEV}"]
    for k in range(1, EPOCHS + 1):
        out.append(f"""
train_loss{k} AS (
  SELECT -sum(n_t * ln(denom / len)) / sum(n_t) AS loss
  FROM (SELECT DISTINCT conv_id, turn, t, n_t, len, denom FROM (
    SELECT conv_id, turn, t, n_t, len, sum(n_s * p) OVER (PARTITION BY conv_id, turn, t) AS denom
    FROM cells JOIN lex{k - 1} USING (s, t)))),
dev_loss{k} AS (
  SELECT -sum(n_t * ln(q + 1e-6)) / sum(n_t) AS dev_loss
  FROM (SELECT conv_id, turn, t, any_value(n_t) AS n_t, sum(n_s * coalesce(p, 0)) / any_value(len) AS q
    FROM dev_cells LEFT JOIN lex{k} USING (s, t) GROUP BY conv_id, turn, t))""")
    union = " UNION ALL ".join(f"SELECT {k} AS epoch, loss, dev_loss FROM train_loss{k}, dev_loss{k}" for k in range(1, EPOCHS + 1))
    out.append(f"history AS ({union})")
    return ",".join(out)


SQL = {
    "scan_parallel": f"WITH {_PAIRS} SELECT conv_id, turn, src, trg FROM prs",
    "scan_lexicon": f"WITH {_PAIRS}, {_lexicon('late', 'prs')} SELECT trg, src, prob FROM late",
    "lexicon_fit": f"{_FITTED} SELECT src_id, trg_id, round(prob, 8) AS prob, clipped FROM fitted",
    "lexicon_lookup": f"""{_FITTED},
whole AS (
  SELECT sv.id AS src_id, count(*) AS n_targets,
    sum(CASE WHEN trg_id IS NULL THEN 1.0 WHEN trg_id = 0 THEN prob ELSE 0.0 END) AS unk_prob
  FROM sv LEFT JOIN fitted ON src_id = sv.id GROUP BY sv.id),
{sql.spread("asked", "conversations", "conv_id, turn", sql.words("text"))}
SELECT conv_id, turn, pos, asked.tok, n_targets, round(unk_prob, 8) AS unk_prob
FROM asked LEFT JOIN sv ON sv.tok = asked.tok JOIN whole ON src_id = coalesce(sv.id, 0)""",
    "ibm1_lexicon": _IBM1,
    "ibm1_resume": _IBM1,
    "alignment_long": f"""{_ALIGN}
SELECT conv_id, turn, src_pos, src, trg_pos, trg, round(weight, 6) AS weight FROM named""",
    "alignment_matrix": f"""{_ALIGN}
SELECT conv_id, turn, src_pos, src,
  string_agg(CAST(CAST(CAST(weight AS DECIMAL(18, 6)) AS DECIMAL(18, 3)) AS VARCHAR), ' ' ORDER BY trg_pos) AS weights
FROM named GROUP BY conv_id, turn, src_pos, src""",
    "translate_gloss": f"{_GLOSS} SELECT conv_id, turn, output FROM gloss",
    "sample_report": f"""{_GLOSS}
SELECT conv_id, turn, 'SRC: ' || src || chr(10) || 'OUT: ' || output || chr(10) || 'REF: ' || trg AS report
FROM prs JOIN gloss USING (conv_id, turn)""",
    "lexicon_rescore": f"""{_EM},
ranked AS (
  SELECT s, t, p, row_number() OVER (PARTITION BY s ORDER BY round(ln(p), 9) DESC, t) AS rank FROM {_LEX} WHERE t <> 0),
short AS (
  SELECT s, t, p FROM ranked WHERE rank <= {SHORT}
  UNION ALL
  SELECT s, 0, greatest(1.0 - coalesce(sum(p) FILTER (WHERE rank <= {SHORT}), 0), 0)
  FROM (SELECT DISTINCT s FROM {_LEX}) LEFT JOIN ranked USING (s) GROUP BY s),
share AS (SELECT conv_id, turn, s, count(*) / CAST(sum(count(*)) OVER (PARTITION BY conv_id, turn) AS DOUBLE) AS a FROM es GROUP BY conv_id, turn, s),
counts AS (SELECT t, count(*) AS n FROM et GROUP BY t),
frequent AS (SELECT t FROM counts ORDER BY n DESC, t LIMIT {FREQUENT}),
cand AS (
  SELECT conv_id, turn, t, max(mixed) AS mixed FROM (
    SELECT conv_id, turn, t, sum(a * p) AS mixed FROM share JOIN short USING (s) GROUP BY ALL
    UNION ALL SELECT DISTINCT conv_id, turn, frequent.t, 0.0 FROM share, frequent) GROUP BY ALL),
scored AS (
  SELECT *, ln((coalesce(n, 0) + 1) / (SELECT CAST(sum(n) AS DOUBLE) FROM counts)) AS score FROM cand LEFT JOIN counts USING (t)),
biased AS (
  SELECT *, score + ln(0.001 + mixed) AS bias,
    exp(score) / sum(exp(score)) OVER (PARTITION BY conv_id, turn) AS p FROM scored)
SELECT conv_id, turn, tok AS trg, round(mixed, 6) AS mixed, round(bias, 6) AS bias,
  round(exp(bias) / sum(exp(bias)) OVER (PARTITION BY conv_id, turn), 6) AS p_bias,
  round(mixed / (1 + exp(-0.5)) + p * (1 - 1 / (1 + exp(-0.5))), 6) AS linear
FROM biased JOIN tv ON tv.id = t""",
    "interpolate_scores": f"""WITH {sql.DOC_LINES}, {sql.TALK_LINES},
{sql.pairs("dp", "doc_lines", "doc_id", sql.marked(sql.words("text")))},
{sql.pairs("tp", "talk_lines", "conv_id", sql.marked(sql.words("text")))},
d AS (SELECT prev, next, count(*) / CAST(sum(count(*)) OVER (PARTITION BY prev) AS DOUBLE) AS x FROM dp GROUP BY prev, next),
c AS (SELECT prev, next, count(*) / CAST(sum(count(*)) OVER (PARTITION BY prev) AS DOUBLE) AS y FROM tp GROUP BY prev, next),
merged AS (SELECT prev, next, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM d FULL JOIN c USING (prev, next))
SELECT prev, next, round(ln((x + y) / 2), 6) AS ln_even,
  round(ln(x / (1 + exp(-1.5)) + y * (1 - 1 / (1 + exp(-1.5)))), 6) AS ln_lean FROM merged""",
    "alignment_header": f"""{_FIT}, {_CUT}
SELECT conv_id, turn, string_agg(tok, ' ' ORDER BY pos) AS words FROM cut_trg JOIN tv ON tv.id = t GROUP BY conv_id, turn""",
    "alignment_held_out": f"""{_EM}, {_DEV},
held AS (
  SELECT conv_id, turn, dt.pos AS trg_pos, p, coalesce(p, 1e-6) / sum(coalesce(p, 1e-6)) OVER (PARTITION BY conv_id, turn, dt.pos) AS weight
  FROM ds JOIN dt USING (conv_id, turn) LEFT JOIN {_LEX} USING (s, t))
SELECT conv_id, turn, trg_pos, count(*) AS n_src, count(*) FILTER (WHERE p IS NULL) AS n_unseen,
  round(sum(weight), 6) AS total, round(max(weight), 6) AS largest FROM held GROUP BY ALL""",
    "epoch_history": f"""{_history()}
SELECT epoch, round(loss, 5) AS loss, round(previous, 5) AS previous, round(dev_loss, 5) AS dev_loss, loss < previous AS improved
FROM (SELECT *, lag(loss, 1, {FIRST_LOSS}) OVER (ORDER BY epoch) AS previous FROM history)""",
    "pad_batches": f"""{_FIT},
s_ids AS (SELECT conv_id, turn, list(s ORDER BY pos) AS src FROM es GROUP BY ALL),
t_ids AS (SELECT conv_id, turn, list(t ORDER BY pos) AS trg FROM et GROUP BY ALL),
placed AS (
  SELECT *, (row_number() OVER (ORDER BY len(src) DESC, conv_id, turn) - 1) // {BATCH} AS batch_id
  FROM s_ids JOIN t_ids USING (conv_id, turn)),
wide AS (
  SELECT *, max(len(src)) OVER (PARTITION BY batch_id) AS ws, max(len(trg)) OVER (PARTITION BY batch_id) AS wt FROM placed)
SELECT batch_id, conv_id, turn, array_to_string(list_resize(src, ws, {PAD_ID}), ' ') AS src,
  array_to_string(list_resize(trg, wt, {PAD_ID}), ' ') AS trg FROM wide""",
}
