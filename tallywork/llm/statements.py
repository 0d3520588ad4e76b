"""DuckDB statements that recompute the queries SQL can express."""

from __future__ import annotations

STATEMENTS: dict[str, str] = {}

STATEMENTS["op2_positional_decontamination"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
doc_win AS (
  SELECT r, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT r, s, win.n, item FROM doc_win JOIN win USING (n, phrase)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r),
doc_word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc),
win_word AS (SELECT win_no, item, n, word, count(*) AS need FROM (
  SELECT win_no, item, n, unnest(string_split(phrase, ' ')) AS word
  FROM (SELECT row_number() OVER () AS win_no, * FROM win)) GROUP BY ALL),
df AS (SELECT word, count(*) AS c FROM doc_word GROUP BY word),
per_win AS (SELECT win_no, any_value(item) AS item, any_value(n) AS n, count(*) AS terms FROM win_word GROUP BY win_no),
anchor AS (SELECT win_no, arg_min(word, c) AS word FROM win_word JOIN df USING (word) JOIN per_win USING (win_no)
           GROUP BY win_no HAVING count(*) = any_value(terms)),
start_at AS (SELECT DISTINCT win_no, r, greatest(d.p - g, 1) AS s, n
             FROM anchor JOIN doc_word d USING (word) JOIN per_win USING (win_no), range(0, 15) t(g) WHERE g < n + 5),
have AS (SELECT s.win_no, s.r, s.s, w.word, any_value(w.need) AS need, count(*) AS got
         FROM start_at s JOIN win_word w ON w.win_no = s.win_no
         JOIN doc_word d ON d.r = s.r AND d.word = w.word AND d.p >= s.s AND d.p < s.s + s.n + 5
         GROUP BY s.win_no, s.r, s.s, w.word),
full_win AS (SELECT win_no, r, s FROM have JOIN per_win USING (win_no) WHERE got >= need
             GROUP BY win_no, r, s HAVING count(*) = any_value(terms)),
near AS (SELECT r, count(DISTINCT item) AS n_near FROM full_win JOIN per_win USING (win_no) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near_items
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r) LEFT JOIN near USING (r)
"""

STATEMENTS["op5_line_first_quality"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (SELECT r, s, w[s] || ' ' || w[s + 1] || ' ' || w[s + 2] AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS s FROM doc WHERE len(w) > 2)),
often AS (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([s, s + 1, s + 2]) AS p FROM tri JOIN often USING (r, g))
        GROUP BY r),
line AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM doc),
core AS (SELECT r, l, regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS c FROM line),
judged AS (
  SELECT r, l, c, c <> '' AND (
    len(c) <= 400 AND NOT regexp_matches(c, '[.!?:;…。！？؟।]["'')\]}”’»]*$')
    OR len(regexp_extract_all(c, '[|¦»•·]| [>/] ')) >= greatest(3, len(c) / 100)
    OR len(regexp_extract_all(c, '[#*$%&|<>]')) > 0.1::DOUBLE * len(c)
    OR (upper(c) = c AND lower(c) <> c AND len(regexp_replace(c, '[^\pL]', '', 'g')) >= 5)
    OR len(c) <= 400 AND regexp_matches(lower(c), 'all rights reserved|licensed under|terms of use|terms of service|privacy policy|cookie policy|we use cookies|accept cookies|accept all cookies|enable javascript|click here|sign in to|log in to|subscribe now|subscribe to our|copyright \(c\)|copyright ©|lorem ipsum|skip to content|skip to main content|share this|read more')
  ) AS bad, CASE WHEN len(c) <= 400 THEN 0 ELSE len(regexp_replace(array_to_string(list_filter(
    regexp_extract_all(c, '[^.!?…。！？؟।]*[.!?…。！？؟।]*'), lambda s: regexp_matches(lower(s), 'all rights reserved|licensed under|terms of use|terms of service|privacy policy|cookie policy|we use cookies|accept cookies|accept all cookies|enable javascript|click here|sign in to|log in to|subscribe now|subscribe to our|copyright \(c\)|copyright ©|lorem ipsum|skip to content|skip to main content|share this|read more')), ''), '[\x20\x09-\x0D]', '', 'g')) END AS part
  FROM core),
lines AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (bad) AS n_removed,
         count(*) FILTER (c <> '') - count(DISTINCT l) FILTER (c <> '') AS n_dup,
         sum(CASE WHEN bad THEN len(regexp_replace(c, '[\x20\x09-\x0D]', '', 'g')) ELSE part END) AS lost
  FROM judged GROUP BY r),
counted AS (
  SELECT doc.*, n_lines, n_removed, n_dup, lost, coalesce(rep.n, 0) AS again,
         len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS symbols
  FROM doc JOIN lines USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, len(w)::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols,
       n_dup::BIGINT AS n_dup_lines, again::BIGINT AS n_repeat_words,
       len(w) < 50 OR 100 * again > 50 * len(w) AS base_failed, n_lines::BIGINT AS n_lines,
       n_removed::BIGINT AS n_removed_lines,
       NOT (len(w) < 50 OR 100 * again > 50 * len(w)) AND lost <= 0.3::DOUBLE * chars AS kept
FROM counted
"""

STATEMENTS["op8_hash_threshold_mix"] = r"""
WITH sized AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         2 * source_size AS most FROM src),
filled AS (
  SELECT *, row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS no,
         sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS most_upto,
         sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS weight_upto,
         sum(weight) OVER () AS weight_all, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM weighed),
cut AS (
  SELECT arg_min(level, no) AS level FROM (
    SELECT no, (budget - most_upto + most) / (weight_all - weight_upto + weight) AS level, most::DOUBLE / weight AS edge
    FROM filled) WHERE edge >= level),
targets AS (
  SELECT source, source_size, CASE WHEN most < weight * level THEN most::DOUBLE ELSE weight * level END AS target
  FROM filled, cut),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
tied AS (SELECT source, h, sum(size) AS s FROM sized GROUP BY source, h),
upto AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY h) AS u FROM tied),
picked AS (
  SELECT upto.source, h, u <= target - whole * source_size
         OR (u - s <= target - whole * source_size AND 2 * (target - whole * source_size - (u - s)) >= s) AS again
  FROM upto JOIN plan ON upto.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN again THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
JOIN picked ON sized.source IS NOT DISTINCT FROM picked.source AND sized.h = picked.h
"""

STATEMENTS["op10_digest_array_urls"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://')
                       THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
part AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM cut),
rules(host_of, path_of, says) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT p.*, host_of || path_of AS rule, says,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path
                            ORDER BY length(host_of || path_of) DESC, length(host_of) DESC) AS no
  FROM (SELECT DISTINCT * FROM part) p JOIN rules
    ON (p.host = host_of OR ends_with(p.host, '.' || host_of)) AND starts_with(p.path, path_of))
SELECT part.page_id, part.host, part.path, rule,
       coalesce(says, CASE WHEN len(list_filter(regexp_split_to_array(part.host, '[-_.]+'), lambda x: x IN (
         'adult', 'ads', 'bet', 'bets', 'bingo', 'casino', 'escort', 'gamble', 'gambling', 'jackpot', 'malware',
         'phishing', 'pills', 'poker', 'porn', 'sex', 'slots', 'spam', 'torrent', 'viagra', 'warez', 'xxx'))) > 0
         THEN 'block' ELSE 'allow' END) AS verdict
FROM part LEFT JOIN (SELECT * FROM fits WHERE no = 1) f
  ON part.page_id IS NOT DISTINCT FROM f.page_id AND part.host = f.host AND part.path = f.path
"""

STATEMENTS["op3_perfect_hash_line_dedup"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT r, doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM doc),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
judged AS (SELECT keyed.*, often.k IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM keyed LEFT JOIN often USING (k))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

STATEMENTS["op7_super_kmer_dedup"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
             FROM documents),
win AS (SELECT r, doc_id, s, array_to_string(w[s : s + 19], ' ') AS phrase
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM doc WHERE len(w) >= 20)),
head AS (SELECT phrase, min(struct_pack(d := coalesce(doc_id, -9223372036854775808), s := s)) AS f FROM win GROUP BY phrase HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(s, s + 20)) AS p FROM win JOIN head USING (phrase)
                                    WHERE struct_pack(d := coalesce(doc_id, -9223372036854775808), s := s) > f)),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t, count(gone.p) AS n
              FROM word LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN left_over USING (r)
"""

# The CRC-32 of the decimal id is computed bit by bit: every eighth step takes in the next character.
STATEMENTS["op11_block_prefix_trie"] = r"""
WITH RECURSIVE
turn_row AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
             FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, digest, length(text) AS size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS p FROM turn_row),
crc(c, step, v) AS (
  SELECT DISTINCT c, 0, 4294967295::BIGINT FROM own
  UNION ALL
  SELECT c, step + 1, xor(w >> 1, CASE WHEN w & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT c, step, CASE WHEN step % 8 = 0 THEN xor(v, ascii(substr(c::VARCHAR, step // 8 + 1, 1))::BIGINT) ELSE v END AS w
        FROM crc WHERE step < 8 * length(c::VARCHAR)) t),
head AS (SELECT c, c - c % 100 AS b, xor(arg_max(v, step), 4294967295) % 6 AS h FROM crc GROUP BY c),
given AS (SELECT head.c AS c, h, count(own.p) AS k FROM head LEFT JOIN own ON own.c = head.b AND own.p <= head.h GROUP BY head.c, h, b),
rebuilt AS (
  SELECT head.c, own.p, digest, size FROM head JOIN own ON own.c = head.b AND own.p <= head.h
  UNION ALL
  SELECT own.c, own.p - h + k, digest, size FROM own JOIN given ON own.c = given.c WHERE own.p > h),
path AS (SELECT c, p, size, string_agg(digest, '') OVER (PARTITION BY c ORDER BY p) AS seq FROM rebuilt
         UNION ALL SELECT c, 0, 0, '' FROM head),
node AS (SELECT p, seq, min(c) AS c, count(*) AS n, any_value(size) AS size FROM path GROUP BY p, seq),
kids AS (SELECT p - 1 AS p, left(seq, length(seq) - 64) AS seq, count(*) AS n FROM node WHERE p > 0 GROUP BY ALL),
grown AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (p, seq)),
ends AS (SELECT p, seq, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids
         FROM (SELECT c, max(p) AS p, arg_max(seq, p) AS seq FROM path GROUP BY c) GROUP BY p, seq),
below AS (SELECT a.p, a.seq, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n - 1) * b.size) AS saved
          FROM grown a JOIN grown b ON b.p >= a.p AND starts_with(b.seq, a.seq) GROUP BY a.p, a.seq)
SELECT node.c AS conv_id, node.p::BIGINT AS depth, up.c AS parent_conv_id, node.n::BIGINT AS n_convs,
       node.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM grown node JOIN below USING (p, seq) LEFT JOIN ends USING (p, seq)
LEFT JOIN node up ON up.p = node.p - 1 AND up.seq = left(node.seq, greatest(length(node.seq) - 64, 0))
"""

STATEMENTS["op12_shared_term_search"] = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM doc),
wanted AS (SELECT DISTINCT q, item_id, unnest(w) AS term FROM item),
posting AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM doc)
            WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * total.n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
            FROM posting, total GROUP BY term, total.n),
worth AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * p.n * total.n) // total.l))) AS s
          FROM posting p JOIN weighed USING (term), total),
scored AS (SELECT q, item_id, r, doc_id, sum(s)::BIGINT AS score FROM wanted JOIN worth USING (term) GROUP BY ALL HAVING sum(s) > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 10
"""

STATEMENTS["op13_heavy_hitter_dedup"] = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, sha256(coalesce(text, '')) AS h FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST, r) AS no,
                  max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM doc)
SELECT doc_id, keep_id, n AS group_size, no = 1 AS kept, h AS text_sha256 FROM ranked
"""
