"""Check queries, in DuckDB SQL, of the corpus operators that SQL can express."""

from __future__ import annotations

import math

from barloom.llm import license_scan as scan

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_sql() -> str:
    """Every block that begins with a word of a template, counted in full."""
    phrase_rows, template_rows = [], []
    for label, text in scan.PHRASES:
        words = text.split()
        lead = " AND ".join(f"lead(word, {k}) OVER o = '{w}'" if k else f"word = '{w}'" for k, w in enumerate(words))
        phrase_rows.append(f"CASE WHEN {lead} THEN '{label}' END")
    for k, (label, text) in enumerate(scan.TEMPLATES):
        words = text.split()
        needed = max(1, math.ceil(scan.THRESHOLD * len(set(words)) - 1e-9))
        template_rows += [f"({k}, '{label}', {len(words)}, {len(set(words))}, {needed}, '{w}')" for w in sorted(set(words))]
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
tokens AS (SELECT r, unnest(range(len(words))) AS pos, unnest(words) AS word FROM texts),
marked AS (SELECT r, pos, unnest([{", ".join(phrase_rows)}]) AS label FROM tokens WINDOW o AS (PARTITION BY r ORDER BY pos)),
places AS (SELECT r, pos, label FROM marked WHERE label IS NOT NULL),
base AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY r),
templates(template, label, n, size, needed, word) AS (VALUES {", ".join(template_rows)}),
held AS (SELECT t.r, t.pos, t.word, p.template, p.label, p.n, p.size, p.needed FROM tokens t JOIN templates p ON t.word = p.word),
blocks AS (
  SELECT a.r, a.label, count(DISTINCT b.word) / any_value(a.size)::DOUBLE AS share
  FROM held a JOIN held b ON a.r = b.r AND a.template = b.template AND b.pos BETWEEN a.pos AND a.pos + a.n - 1
  GROUP BY a.r, a.template, a.label, a.pos HAVING count(DISTINCT b.word) >= any_value(a.needed)),
labelled AS (SELECT r, label, 1.0::DOUBLE AS share, true AS own FROM places UNION ALL SELECT r, label, share, false FROM blocks),
found AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE own) AS base_labels, max(share) AS score
  FROM labelled GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
  last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""


def collocation_sql(most: int = 2000, least: int = 10, inside: int = 50) -> str:
    """Every run of one to three words of every piece, counted."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k + 1} AS k, unnest([array_to_string(words[i:i+{k}], ' ') FOR i IN range(1, len(words) - {k} + 1)]) AS phrase FROM pieces"
        for k in range(3)
    )
    return f"""
WITH lines AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
pieces AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\\x20\\x09]+') IF x <> ''] AS words FROM lines),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
many AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE k > 1 AND f >= {least}),
cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(words[1:cut], ' ') AS first, array_to_string(words[cut+1:k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM many)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
    (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS f FROM (
    SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a FROM many WHERE k = 3)
  GROUP BY ALL),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g USING (lang, phrase) WHERE g.f IS NULL OR 100 * g.f < {inside} * b.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= {most}
"""
