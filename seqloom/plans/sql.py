"""Shared pieces of the SQL that states each query's result independently."""

from __future__ import annotations


def words(text: str, lower: bool = True) -> str:
    text = f"lower({text})" if lower else text
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: x <> '')"


def marked(array: str) -> str:
    return f"list_concat(['<s>'], {array}, ['</s>'])"


def with_eos(array: str) -> str:
    return f"list_concat({array}, ['<EOS>'])"


DOC_LINES = """
doc_lines AS (
  SELECT doc_id, lang, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS text
  FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"""

TALK_LINES = """
talk_lines AS (
  SELECT conv_id, turn, role, CAST(unnest(range(len(l))) AS INT) AS line_no, unnest(l) AS text
  FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS l FROM conversations))"""


def spread(name: str, source: str, keys: str, array: str) -> str:
    """CTE with one row per array element: keys, pos, tok."""
    return f"""
{name} AS (
  SELECT {keys}, CAST(unnest(range(len(w))) AS INT) AS pos, unnest(w) AS tok
  FROM (SELECT {keys}, {array} AS w FROM {source}))"""


def pairs(name: str, source: str, keys: str, array: str) -> str:
    """CTE with one row per word and its follower: keys, pos, prev, next."""
    return f"""
{name} AS (
  SELECT {keys}, CAST(unnest(range(len(w) - 1)) AS INT) AS pos, unnest(w[1:len(w) - 1]) AS prev, unnest(w[2:]) AS next
  FROM (SELECT {keys}, {array} AS w FROM {source}))"""


def vocabulary(name: str, tokens: str, order: str, markers: list[str], cut: int | None = 1) -> str:
    """CTE (tok, id): markers first, then words above the cut in order of first occurrence."""
    names = ", ".join(f"'{m}'" for m in markers)
    fixed = " UNION ALL ".join(f"SELECT '{m}', {i}" for i, m in enumerate(markers))
    having = "" if cut is None else f"HAVING count(*) > {cut}"
    return f"""
{name} AS (
  SELECT tok, CAST(id AS INT) AS id FROM (
    SELECT tok, {len(markers) - 1} + row_number() OVER (ORDER BY first) AS id
    FROM (SELECT tok, min(({order})) AS first FROM {tokens} WHERE tok NOT IN ({names}) GROUP BY tok {having})
    UNION ALL {fixed}))"""


LANGUAGE = ["<UNK>", "<EOS>", "{*}", "<s>", "</s>"]
TRANSLATION = ["<UNK>", "<EOS>", "{*}"]
TAGS = ["<EOS>", "{*}"]

DOC_TOKENS = spread("doc_tokens", "doc_lines", "doc_id, line_no, lang", words("text"))
DOC_VOCABULARY = vocabulary("voc", "doc_tokens", "doc_id, line_no, pos", LANGUAGE)
DOC_FIT = f"WITH {DOC_LINES}, {DOC_TOKENS}, {DOC_VOCABULARY}"


def joined_ids(source: str, keys: str, array: str, voc: str = "voc") -> str:
    """CTE encoded(keys, ids): id lists as text; unknown words are 0."""
    return f"""
{spread("marked_tokens", source, keys, array)},
encoded AS (
  SELECT {keys}, string_agg(CAST(coalesce(id, 0) AS VARCHAR), ' ' ORDER BY pos) AS ids
  FROM marked_tokens LEFT JOIN {voc} USING (tok) GROUP BY {keys})"""


def bigram_model(pair_cte: str, seq: str, weight: float = 0.7) -> str:
    """CTEs of the language model: voc, bi(prev, next, n), before, after, size(total, types)."""
    return f"""
train_tokens AS (SELECT next AS tok, {seq} FROM {pair_cte} WHERE next <> '</s>'),
{vocabulary("voc", "train_tokens", seq, LANGUAGE)},
bi AS (
  SELECT coalesce(a.id, 0) AS prev, coalesce(b.id, 0) AS next, count(*) AS n
  FROM {pair_cte} p LEFT JOIN voc a ON p.prev = a.tok LEFT JOIN voc b ON p.next = b.tok GROUP BY 1, 2),
before AS (SELECT prev, CAST(sum(n) AS BIGINT) AS n_prev FROM bi GROUP BY 1),
after AS (SELECT next, CAST(sum(n) AS BIGINT) AS n_next FROM bi GROUP BY 1),
size AS (SELECT (SELECT sum(n) FROM bi) AS total, (SELECT count(*) - 3 FROM voc) AS types)"""


def probability(n: str, n_prev: str, n_next: str, weight: float = 0.7) -> str:
    base = f"(coalesce({n_next}, 0) + 1) / CAST(size.total + size.types AS DOUBLE)"
    return (
        f"CASE WHEN coalesce({n_prev}, 0) > 0 THEN {weight} * coalesce({n}, 0) / CAST({n_prev} AS DOUBLE)"
        f" + {1 - weight!r} * {base} ELSE {base} END"
    )
