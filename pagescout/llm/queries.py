"""The registered queries of the text operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagescout.llm import (
    collocations,
    conversation_repair,
    decontaminate,
    interpolated_lm,
    line_dedup,
    mixing,
    ngram_join,
    piece_encoding,
    quality_gam,
    quality_rules,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return mixing.interleave(docs)


# One slot of the round is one step of the recursion; "done" counts the blocks of each source so far.
ORACLE["op8_mixing"] = """
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS source, sqrt(count(*)) AS w FROM documents GROUP BY 1),
weighted AS (SELECT source, w, greatest(1000, 2 * count(*) OVER ()) AS q, count(*) OVER () AS s, sum(w) OVER () AS total FROM sizes),
exact AS (SELECT source, q, (q - s) * w / total AS e FROM weighted),
parts AS (SELECT source, q, 1 + floor(round(e, 9))::BIGINT AS part, round(e - floor(e), 9) AS rest FROM exact),
shares AS (SELECT source, q, part + (row_number() OVER (ORDER BY rest DESC, source)
             <= q - sum(part) OVER ())::BIGINT AS share FROM parts),
setup AS (SELECT list(source ORDER BY source) AS sources, list(share ORDER BY source) AS share, max(q) AS q FROM shares),
rounds AS (
  SELECT 0::BIGINT AS slot, [0::BIGINT for x in share] AS done, NULL::BIGINT AS k, NULL::BIGINT AS turn FROM setup
  UNION ALL
  SELECT slot + 1, [done[i] + (i = pick.k)::BIGINT for i in range(1, len(done) + 1)], pick.k, pick.turn
  FROM (SELECT slot, done, list_min([{'due': ceil((done[i] + 1) * q / share[i]), 'k': i, 'turn': done[i]}
          for i in range(1, len(done) + 1) if floor(done[i] * q / share[i]) <= slot]) AS pick
        FROM rounds, setup WHERE slot < q)
),
plan AS (SELECT sources[k] AS source, turn, slot - 1 AS slot FROM rounds, setup WHERE k IS NOT NULL),
ranked AS (SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) - 1 AS r FROM documents),
blocks AS (SELECT doc_id, r.source, r.s, r % 16 AS place, (r // 16) // share AS round, (r // 16) % share AS turn, q FROM ranked r JOIN shares ON r.s = shares.source)
SELECT doc_id, b.source, round * q + slot AS mix_slot, place::INTEGER AS mix_place
FROM blocks b JOIN plan p ON p.source = b.s AND p.turn = b.turn
"""


@query
def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


_WORDS_10 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op10_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_10} AS w FROM documents),
it AS (SELECT item_id, {_WORDS_10} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM it WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""


@query
def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# Lines of at least six words are near if taking out the word at one place leaves the same words,
# or if one is what the other leaves; lines of fewer words and 24 characters or more likewise by characters.
ORACLE["op5_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
occ AS (SELECT r, doc_id, t, i, lines[i] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d) WHERE regexp_matches(lines[i], '[^\x20\x09-\x0D]')),
placed AS (SELECT r, i, line, row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(doc_id::VARCHAR, '') || chr(10) || t), i) AS pos FROM occ),
dl AS (SELECT line, min(pos) AS first, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM placed GROUP BY line),
long AS (SELECT line, first, 'w' AS u, w FROM dl WHERE len(w) >= 6 UNION ALL SELECT line, first, 'c' AS u, regexp_extract_all(line, '(?s).') AS w FROM dl WHERE len(w) < 6 AND length(line) >= 24),
v AS (SELECT line, first, u, i, len(w) - 1 AS n, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM long)
      UNION ALL SELECT line, first, u, i, len(w) AS n, array_to_string(w, ' ') AS k FROM (SELECT *, unnest(range(1, len(w) + 2)) AS i FROM long)),
heads AS (SELECT k, u, i, n, min(first) AS head FROM v GROUP BY ALL),
near AS (SELECT DISTINCT line FROM v JOIN heads USING (k, u, i, n) WHERE head < first),
gone AS (SELECT r, list(i) AS gone, count(*) AS n FROM placed p JOIN dl USING (line) WHERE pos > first OR line IN (SELECT line FROM near) GROUP BY r),
worded AS (SELECT r, count(*) AS n FROM occ GROUP BY r)
SELECT doc_id, coalesce(w.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g.n IS NULL THEN t ELSE array_to_string([lines[i] for i in range(1, len(lines) + 1) if NOT list_contains(gone, i)], chr(10)) END) AS text_sha256
FROM d LEFT JOIN gone g USING (r) LEFT JOIN worded w USING (r)
"""


@query
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality_rules.apply_rules(docs.select("doc_id", "lang", "text"), keep=["doc_id"])


_CLASSES = ["a-z", r"\x20\x09-\x0D", "A-Z", r"\x{80}-\x{10FFFF}", "0-9", ".,;:''\"?!()\\-"]
_SIZES = ", ".join(f"len(regexp_replace(t, '[^{c}]+', '', 'g'))" for c in _CLASSES)
_COMMON = ", ".join(f"'{w}'" for w in quality_rules.common_words())
_LIMITS = quality_rules.Limits()
ORACLE["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT r, len(w)::BIGINT AS n_words, len(t) AS total, [{_SIZES}] AS sizes, len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win
  JOIN (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1) USING (r, g)) GROUP BY r),
m AS (SELECT d.r, doc_id, lang, n_words, total, list_concat(sizes, [total - list_sum(sizes)]) AS chars, total - sizes[2] AS word_chars, n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  n_words < 20 OR 100 * coalesce(rep.n, 0) > 30 * n_words AS base_failed FROM d JOIN c USING (r) LEFT JOIN rep USING (r)),
cw AS (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+')) AS x FROM d) WHERE x IN ({_COMMON}) GROUP BY r, x),
good AS (SELECT * FROM m WHERE NOT base_failed AND lang IS NOT NULL AND n_words >= {_LIMITS.least_words}),
langs AS (SELECT lang, sum(n_words) AS n FROM good GROUP BY lang HAVING sum(n_words) >= {_LIMITS.least_reference_words}),
qc AS (SELECT lang, i, sum(chars[i]) / sum(sum(chars[i])) OVER (PARTITION BY lang) AS q FROM (SELECT lang, chars, unnest(range(1, 8)) AS i FROM good) GROUP BY lang, i),
words AS (SELECT unnest([{_COMMON}]) AS x),
qw AS (SELECT l.lang, w.x, coalesce(s.n, 0) / l.n AS q FROM langs l CROSS JOIN words w
  LEFT JOIN (SELECT lang, x, sum(cw.n) AS n FROM good JOIN cw USING (r) GROUP BY lang, x) s ON s.lang = l.lang AND s.x = w.x),
other AS (SELECT lang, '' AS x, 1 - sum(q) AS q FROM qw GROUP BY lang),
pc AS (SELECT r, lang, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END) AS v
  FROM (SELECT r, qc.lang, q, chars[i] / greatest(total, 1) AS p FROM m, qc WHERE qc.lang IN (SELECT lang FROM langs)) GROUP BY r, lang),
pw0 AS (SELECT r, x, n FROM cw UNION ALL SELECT m.r, '', n_words - coalesce((SELECT sum(n) FROM cw WHERE cw.r = m.r), 0) FROM m),
pw AS (SELECT r, lang, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END) + (1 - sum(q)) / 2 AS v
  FROM (SELECT r, l AS lang, q, pw0.n / greatest(n_words, 1) AS p FROM pw0 JOIN m USING (r) JOIN (SELECT lang AS l, x, q FROM qw UNION ALL SELECT * FROM other) USING (x))
  GROUP BY r, lang),
near AS (SELECT r, min({{'both': sqrt(greatest(pc.v, 0)) + sqrt(greatest(pw.v, 0)), 'c': sqrt(greatest(pc.v, 0)), 'w': sqrt(greatest(pw.v, 0))}}) AS n FROM pc JOIN pw USING (r, lang) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(n.c, 6) AS char_distance, round(n.w, 6) AS word_distance,
  NOT base_failed AND NOT ((lang IS NULL OR lang IN (SELECT lang FROM langs)) AND (coalesce(total >= {_LIMITS.least_chars} AND n.c > {_LIMITS.chars}, false)
  OR coalesce(n_words >= {_LIMITS.least_words} AND n.w > {_LIMITS.words}, false))) AS kept
FROM m LEFT JOIN near USING (r)
"""


@query
def op2_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf, "documents")).drop("key")


ORACLE["op2_ngram_join"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON a = x.r JOIN n y ON b = y.r WHERE 100 * m >= 80 * (x.n + y.n - m)),
sides AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON reach.b = d.r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN least USING (r) LEFT JOIN n USING (r)
"""


@query
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = substring_dedup.remove_passages(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


ORACLE["op9_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (g)),
lists AS (SELECT r, list(p) AS gone FROM gone GROUP BY r),
words AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
left_over AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (r) LEFT JOIN left_over USING (r)
"""


@query
def op6_interpolated_lm(spark: SparkSession, sf: str) -> DataFrame:
    return interpolated_lm.score_by_fold(table(spark, sf, "documents"))


@query
def op11_piece_encoding(spark: SparkSession, sf: str) -> DataFrame:
    encoded = piece_encoding.encode_texts(table(spark, sf, "documents"))
    return piece_encoding.digest(piece_encoding.decode_ids(encoded))


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    conversations = table(spark, sf, "conversations")
    return conversation_repair.repair(conversations, conversation_repair.damage(conversations))


# The least cost and audit from every state of the grammar, row by row from the last one back. The
# check sum is the usual table-driven one; its table follows from the reversed polynomial.
ORACLE["op12_conversation_repair"] = r"""
WITH RECURSIVE crc_table AS (SELECT [list_reduce([n] || [0 for x in range(8)], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) for n in range(256)] AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
summed AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce([4294967295] || [ord(c)::BIGINT for c in key],
  lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) % 20 AS kind FROM src, crc_table),
rows_ AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM rows_),
judged AS (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS i,
  CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
       WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
       WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'blank')::BIGINT) AS blank,
  sum((fault = 'duplicate')::BIGINT) AS duplicate, sum((fault = 'truncated')::BIGINT) AS truncated, list(i ORDER BY pos) AS initials,
  list({'i': i, 'fault': fault, 'role': role, 'text': text} ORDER BY pos) AS r FROM judged GROUP BY conv_id),
moves(s, r, n) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ways AS (SELECT s, s AS n, 0 AS c, '' AS a FROM range(4) x(s) UNION ALL
  SELECT w.s, m.n, c + 5, a || 'I' FROM ways w JOIN moves m ON m.s = w.n AND m.r <> 's' WHERE len(a) < 2),
edits AS (
  SELECT DISTINCT w.s, i, cut, m.n, w.c + 5 * cut + e.c AS c, a || e.e AS a FROM ways w JOIN moves m ON m.s = w.n, (VALUES ('s'), ('u'), ('a'), ('o')) x(i),
    (VALUES (0), (1)) y(cut), (VALUES ('K', 0), ('R', 1)) e(e, c) WHERE CASE e.e WHEN 'K' THEN m.r = i ELSE m.r <> 's' END
  UNION ALL SELECT s, i, cut, s, 2, 'D' FROM range(4) x(s), (VALUES ('s'), ('u'), ('a'), ('o'), ('x')) z(i), (VALUES (0), (1)) y(cut)),
e AS (SELECT list({'s': s, 'i': i, 'cut': cut, 'n': n, 'c': c, 'a': a}) AS e FROM edits),
back AS (
  SELECT conv_id, len(r) AS k, [{'c': 0, 'a': ''}, {'c': 10, 'a': 'II'}, {'c': 5, 'a': 'I'}, {'c': 0, 'a': ''}] AS v FROM counted
  UNION ALL
  SELECT conv_id, k - 1, [list_min([{'c': x.c + v[x.n + 1].c, 'a': x.a || v[x.n + 1].a} for x in e
      if x.s = s AND x.i = CASE WHEN r[k].fault IN ('blank', 'duplicate') THEN 'x' ELSE r[k].i END AND x.cut = (r[k].fault = 'truncated')::INT]) for s in range(4)]
  FROM back JOIN counted USING (conv_id), e WHERE k > 0),
best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit, regexp_extract_all(v[1].a, 'I*[DKR]') AS steps, len(regexp_extract(v[1].a, 'I*$')) AS extra FROM back WHERE k = 0),
edited AS (SELECT conv_id, j, 'IIII'[1:len(steps[j]) - 1] || CASE WHEN steps[j][-1] = 'D' THEN '' ELSE steps[j][-1] END AS e, r[j] AS row
  FROM (SELECT *, unnest(range(1, len(steps) + 1)) AS j FROM best JOIN counted USING (conv_id))
  UNION ALL SELECT conv_id, 1000000000000, repeat('I', extra), NULL FROM best),
lines AS (SELECT conv_id, j, t, e[t] AS e, row, row_number() OVER (PARTITION BY conv_id ORDER BY j, t) AS place FROM (SELECT *, unnest(range(1, len(e) + 1)) AS t FROM edited)),
spoken AS (SELECT conv_id, string_agg(CASE e WHEN 'K' THEN row.role ELSE CASE WHEN (place - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE row.text END,
    chr(10) ORDER BY place) AS said
  FROM (SELECT *, max((place = 1 AND e = 'K' AND row.i = 's')::INT) OVER (PARTITION BY conv_id) AS sys FROM lines) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(len([1 for k in range(1, len(initials)) if initials[k] || initials[k + 1] NOT IN ('su', 'ua', 'au')]), 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN spoken s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


ORACLE["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
x AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS g, count(*) AS a FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i
  FROM x, (VALUES (1::BIGINT), (2), (3)) t(s) WHERE len(w) >= s) GROUP BY ALL),
f AS (SELECT *, string_split(g, ' ') AS w FROM g WHERE a >= 10),
cut AS (SELECT lang, s, g, a, k, array_to_string(w[1:k], ' ') AS gl, array_to_string(w[k + 1:], ' ') AS gr FROM (SELECT *, unnest(range(1, s)) AS k FROM f WHERE s > 1)),
scored AS (SELECT cut.*, x.a AS l, y.a AS r, (1000000::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.g = gl JOIN f y ON y.lang = cut.lang AND y.g = gr),
best AS (SELECT lang, s, g, a, min({'score': score, 'k': k, 'l': l, 'r': r}) AS c FROM scored GROUP BY ALL),
inside AS (SELECT lang, g, max(a) AS longer FROM (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g, a FROM f WHERE s = 3) GROUP BY ALL),
ranked AS (SELECT lang, g AS phrase, a, c.l AS l, c.r AS r, c.score AS score, row_number() OVER (PARTITION BY lang ORDER BY c.score DESC, a DESC, g) AS rank
  FROM best LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN (SELECT lang, sum(a) AS n FROM g WHERE s = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
