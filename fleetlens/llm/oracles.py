"""SQL twins of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM wins) WHERE c > 1
), cover AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM hits, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '\p{{Lu}}'))::BIGINT AS n_upper, len(regexp_extract_all(text, '[!?]{{2,}}'))::BIGINT AS n_shouts,
         len(list_distinct(words))::BIGINT AS n_distinct_words
  FROM d LEFT JOIN cover ON d.doc_id = cover.doc_id
), b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 12 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_upper > 3 * word_chars THEN 32 ELSE 0 END
    + CASE WHEN 4 * n_shouts > n_words THEN 64 ELSE 0 END
    + CASE WHEN n_words >= 50 AND 100 * n_distinct_words < 20 * least(n_words, 500) THEN 128 ELSE 0 END)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed,
       failed_bits = 0 AS kept, failed_bits, '2024-2' AS policy,
       failed_bits & 3 = 0 AS kept_base_1, failed_bits & 15 = 0 AS kept_2024_1, failed_bits & 255 = 0 AS kept_2024_2,
       CASE failed_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines'
         WHEN 16 THEN 'long_words' WHEN 32 THEN 'capitals' WHEN 64 THEN 'shouting' WHEN 128 THEN 'poor_vocabulary' END AS sole_rule,
       CASE WHEN bit_count(failed_bits) = 1 THEN count(*) OVER (PARTITION BY failed_bits) END AS sole_rule_docs
FROM b
"""

URLS = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'),
         ('block', 'com', '/de/')
), p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM p
), m AS (
  SELECT u.page_id, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.k = 1
"""

EXACT = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256({LOWER}) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY {LOWER})
"""

PREFERENCE = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS k,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (SELECT conv_id, max(k) FILTER (role = 'assistant') AS said_at, count(*) AS n FROM t GROUP BY conv_id
), reply AS (
  SELECT t.conv_id, t.k AS at, t.text FROM t JOIN last ON last.conv_id = t.conv_id AND last.said_at = t.k
), swap AS (
  SELECT a.conv_id, a.at, b.conv_id AS reply_id, b.text AS reply FROM reply a JOIN reply b ON b.conv_id = xor(a.conv_id, 1)
), r AS (
  SELECT t.conv_id, t.k, t.role, CASE WHEN t.k = s.at THEN s.reply ELSE t.text END AS text, s.at FROM t JOIN swap s ON s.conv_id = t.conv_id WHERE t.k <= s.at
), shared AS (
  SELECT r.conv_id, coalesce(min(CASE WHEN c.role <> r.role OR c.text <> r.text THEN r.k END), any_value(r.at) + 1) AS shared_turns
  FROM r JOIN t c ON c.conv_id = r.conv_id AND c.k = r.k GROUP BY r.conv_id
), head AS (
  SELECT l.conv_id, s.reply_id, coalesce(h.shared_turns, l.said_at, l.n) AS shared_turns
  FROM last l LEFT JOIN swap s ON s.conv_id = l.conv_id LEFT JOIN shared h ON h.conv_id = l.conv_id
), said AS (
  SELECT conv_id, k, role, text, true AS is_chosen FROM t UNION ALL SELECT conv_id, k, role, text, false FROM r
), texts AS (
  SELECT h.conv_id, any_value(reply_id) AS reply_id, any_value(shared_turns) AS shared_turns,
         coalesce(string_agg(line, '' ORDER BY k) FILTER (k < shared_turns AND is_chosen), '') AS prompt,
         coalesce(string_agg(line, '' ORDER BY k) FILTER (k >= shared_turns AND is_chosen), '') AS chosen,
         coalesce(string_agg(line, '' ORDER BY k) FILTER (k >= shared_turns AND NOT is_chosen), '') AS rejected,
         count(*) FILTER (k >= shared_turns AND is_chosen AND role = 'assistant') AS chosen_learned,
         count(*) FILTER (k >= shared_turns AND NOT is_chosen AND role = 'assistant') AS rejected_learned
  FROM head h JOIN (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM said) s ON s.conv_id = h.conv_id
  GROUP BY h.conv_id
)
SELECT conv_id AS chosen_id, reply_id AS rejected_id, shared_turns::BIGINT AS shared_turns, length(prompt)::BIGINT AS prompt_chars,
       sha256(prompt) AS prompt_sha256, sha256(chosen) AS chosen_sha256, CASE WHEN reply_id IS NOT NULL THEN sha256(rejected) END AS rejected_sha256,
       chosen_learned, CASE WHEN reply_id IS NOT NULL THEN rejected_learned END AS rejected_learned
FROM texts
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# CRC-32 bit by bit: each character's code is XORed in and followed by eight steps, marked by -1.
_CRC = """xor(list_reduce(
  flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295)"""

MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
  FROM (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf,
           CASE WHEN {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS told
    FROM documents
  )
), nodes AS (
  SELECT tree, 0 AS lvl, place, n, leaf AS d FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, place // 2, n
), tops AS (
  SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), top_nodes AS (
  SELECT 0 AS lvl, place, n, subroot AS d FROM tops
  UNION ALL
  SELECT lvl + 1, place // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY place)) FROM top_nodes WHERE n > 1 GROUP BY lvl, place // 2, n
), top_paths AS (
  SELECT t.tree, t.subroot, coalesce(list({{'l': o.place % 2 = 1, 's': coalesce(s.d, '')}} ORDER BY o.lvl) FILTER (o.lvl IS NOT NULL), []) AS path
  FROM tops t LEFT JOIN top_nodes o ON o.n > 1 AND o.place = t.place >> o.lvl
  LEFT JOIN top_nodes s ON s.lvl = o.lvl AND s.place = xor(o.place, 1) GROUP BY t.tree, t.subroot
), paths AS (
  SELECT l.tree, l.place, l.doc_id, l.leaf, l.told,
         coalesce(list({{'l': o.place % 2 = 1, 's': coalesce(s.d, '')}} ORDER BY o.lvl) FILTER (o.lvl IS NOT NULL), []) AS path
  FROM leaves l LEFT JOIN nodes o ON o.tree = l.tree AND o.n > 1 AND o.place = l.place >> o.lvl
  LEFT JOIN nodes s ON s.tree = o.tree AND s.lvl = o.lvl AND s.place = xor(o.place, 1) GROUP BY l.tree, l.place, l.doc_id, l.leaf, l.told
), whole AS (
  SELECT doc_id, leaf, told, subroot, (SELECT d FROM top_nodes WHERE n = 1) AS root, list_concat(p.path, t.path) AS path
  FROM paths p JOIN top_paths t ON t.tree = p.tree
), folded AS (
  SELECT *, list_reduce(path, lambda a, x: {{'l': false, 's': sha256(CASE WHEN x.l THEN x.s || a.s ELSE a.s || x.s END)}}, {{'l': false, 's': told}}).s AS folded_root
  FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.s), '')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM folded
"""


def licenses(base, templates, least_share: float) -> str:
    """One row per word of a template, joined with the words of texts on the word: the difference of places tells one occurrence from another."""
    values = []
    for number, t in enumerate((*base, *templates)):
        words, keys = [w.decode() for w in t.words()], set(t.key_places())
        values += [f"({number}, '{t.label}', {i}, '{w}', {i in keys}, {len(keys)}, {len(words)}, {number < len(base)})" for i, w in enumerate(words)]
    return rf"""
WITH p(t, label, j, word, is_key, n_keys, size, is_base) AS (VALUES {', '.join(values)}), d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM d
), hits AS (
  SELECT doc_id, t, any_value(label) AS label, any_value(is_base) AS is_base, i - j AS place, count(*) / any_value(size) AS share,
         count(*) FILTER (is_key) = any_value(n_keys) AS has_keys
  FROM w JOIN p ON p.word = w.word GROUP BY doc_id, t, i - j
), found AS (
  SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(place) FILTER (is_base) AS first_word, max(place) FILTER (is_base) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score,
         list({{'label': label, 'place': place, 'share': share}} ORDER BY place, label, share) AS matches
  FROM hits WHERE has_keys AND share >= {least_share} GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN found ON found.doc_id = d.doc_id
"""


AUDIT = rf"""
WITH m AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {WORDS} AS words FROM documents
), f AS (
  SELECT doc_id, part, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END)::BIGINT AS mask
  FROM m
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, mask, count(*) AS docs, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, mask
), x(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT [a, b, c, d, e] AS steps FROM (
    SELECT a.name AS a, b.name AS b, c.name AS c, d.name AS d, e.name AS e FROM x a, x b, x c, x d, x e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
  )
), s AS (
  SELECT array_to_string(steps, '') AS filter_order, unnest(range(1, 6)) AS step, steps FROM orders
), cases AS (
  SELECT filter_order, step, (SELECT bit FROM x WHERE name = steps[step]) AS bit,
         coalesce((SELECT sum(bit) FROM x WHERE list_contains(steps[1:step - 1], name)), 0)::BIGINT AS before
  FROM s
)
SELECT part, filter_order, step::INTEGER AS step,
       coalesce(sum(docs) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
       coalesce(sum(docs) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
       coalesce(sum(docs) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(docs) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(docs * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, cases GROUP BY part, filter_order, step
"""
