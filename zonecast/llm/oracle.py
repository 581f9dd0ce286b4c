"""DuckDB SQL of the queries that SQL can express.

The others are tested against brute-force versions: SQL has no tokenizer or trained model, no draw by hash as the mix
makes, and no components of links between sets.
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The word lists, character classes and limits of the quality rules.
_LISTS = """('en', 1, ['the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'it', 'for', 'on', 'was']),
  ('de', 2, ['der', 'die', 'und', 'in', 'den', 'das', 'von', 'zu', 'mit', 'ist', 'des', 'sich']),
  ('es', 3, ['de', 'la', 'que', 'el', 'en', 'y', 'a', 'los', 'del', 'se', 'las', 'por']),
  ('fr', 4, ['de', 'la', 'le', 'et', 'les', 'des', 'en', 'un', 'du', 'une', 'que', 'est'])"""
_CLASSES = (r"\p{Ll}", r"\p{Lu}", r"\p{Nd}", r"\x20\x09-\x0D", r".,;:?''\"()\-", r"!", r"#*$%&|<>")
_COUNTED = ", ".join(f"length(t) - length(regexp_replace(t, '[{c}]', '', 'g'))" for c in _CLASSES)

#: Suffixes of two labels; each level of the host tree with its parent.
_LONG = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'co.nz', 'com.br', 'co.za', 'co.in')"
_RULES = (("example.com", "/en/7"), ("example.net", "/de/8"), ("com", "/en/"), ("net", "/de/"), ("org", "/es/"))
_RULED = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p in _RULES)


def _strength(table: str, parent: str) -> str:
    rate = f"(({parent}_x + 0.5) / ({parent}_n + 1))"
    return f"""(SELECT least(1e4, greatest(0.5, 1 / greatest(1e-9, CASE WHEN w <> 0 THEN (s - v) / w ELSE 0 END) - 1)) FROM (
  SELECT sum(n * (x / n - {rate}) ** 2) AS s, sum({rate} * (1 - {rate})) AS v, sum({rate} * (1 - {rate}) * (n - 1)) AS w FROM {table} WHERE n > 0))"""


#: Terms of a text: runs of lower-cased letters and digits of ASCII and of all else that is no ASCII.
_TERMS = "regexp_extract_all(" + _LOWER.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL: dict[str, str] = {
    "op1_quality_divergence": f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, t, length(t) AS chars, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
          list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines, [{_COUNTED}] AS seen FROM texts),
base AS (SELECT doc_id, chars, CAST(len(words) AS BIGINT) AS n_words, CAST(chars - seen[4] AS BIGINT) AS word_chars, CAST(seen[7] AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, list_append(seen, chars - list_sum(seen)) AS classes FROM split),
spoken AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM split),
followed AS (SELECT doc_id, pos, word, lead(word, 1) OVER d AS second, lead(word, 2) OVER d AS third FROM spoken WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
windows AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, word, second, third) AS times FROM followed WHERE third IS NOT NULL),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
lists AS (SELECT * FROM (VALUES {_LISTS}) AS l(language, place, list)),
listed AS (SELECT language, place, unnest(list) AS word, unnest(range(1, 13)) AS i FROM lists),
found AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, {_LOWER.format("word")} AS word FROM spoken) WHERE word IN (SELECT word FROM listed) GROUP BY doc_id, word),
hits AS (SELECT doc_id, language, place, sum(n) AS n FROM found JOIN listed USING (word) GROUP BY doc_id, language, place),
chosen AS (SELECT doc_id, language FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, place) = 1),
known AS (SELECT b.*, coalesce(c.language, '') AS language FROM base b LEFT JOIN chosen c USING (doc_id)),
own AS (SELECT k.doc_id, k.language, l.i, coalesce(f.n, 0) AS n FROM known k JOIN listed l USING (language) LEFT JOIN found f ON f.doc_id = k.doc_id AND f.word = l.word),
histograms AS (
  SELECT doc_id, language, 'class' AS kind, unnest(range(1, 9)) AS i, CAST(unnest(classes) AS DOUBLE) AS n FROM known
  UNION ALL SELECT doc_id, language, 'word', i, n FROM own
  UNION ALL SELECT doc_id, language, 'word', 0, any_value(n_words) - sum(n) FROM own JOIN known USING (doc_id, language) GROUP BY doc_id, language),
apart AS (SELECT doc_id, kind, n, sum(n) OVER (PARTITION BY language, kind, i) - n AS m FROM histograms),
shares AS (SELECT doc_id, kind, n / nullif(sum(n) OVER h, 0) AS p, m / nullif(sum(m) OVER h, 0) AS q FROM apart WINDOW h AS (PARTITION BY doc_id, kind)),
distances AS (SELECT doc_id, kind, CASE WHEN count(p) = 0 OR count(q) = 0 THEN 0 ELSE sqrt(greatest(0, sum(
  (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) END AS d FROM shares GROUP BY doc_id, kind),
judged AS (SELECT k.*, coalesce(r.n, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed,
           (chars >= 200 AND coalesce(c.d, 0) > 0.25) OR (n_words >= 100 AND coalesce(w.d, 0) > 0.235) AS far
           FROM known k LEFT JOIN repeated r USING (doc_id) LEFT JOIN distances c ON c.doc_id = k.doc_id AND c.kind = 'class' LEFT JOIN distances w ON w.doc_id = k.doc_id AND w.kind = 'word')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM judged""",
    "op4_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (SELECT doc_id, pos, lines[pos] AS line, {_LOWER.format("trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
          FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split)),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON c.key = k.key GROUP BY doc_id""",
    "op6_exact_dedup": f"""
WITH texts AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)""",
    "op9_host_reputation": f"""
WITH urls AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
              coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {_RULED} END AS rule FROM urls),
counted AS (SELECT host, count(*) AS n, count(rule) FILTER (WHERE rule <> 'example.com/en/7') AS x FROM ruled GROUP BY host),
tails AS (SELECT *, regexp_extract(host, '(?:[^.]*\\.)?[^.]*$') AS two FROM counted),
named AS (SELECT host, n, x, CASE WHEN two IN {_LONG} THEN regexp_extract(host, '(?:[^.]*\\.)?(?:[^.]*\\.)?[^.]*$') ELSE two END AS domain,
          CASE WHEN two IN {_LONG} THEN two ELSE regexp_extract(host, '[^.]*$') END AS suffix FROM tails),
hosts AS (SELECT *, sum(n) OVER d AS domain_n, sum(x) OVER d AS domain_x, sum(n) OVER s AS suffix_n, sum(x) OVER s AS suffix_x, sum(n) OVER () AS all_n, sum(x) OVER () AS all_x
          FROM named WINDOW d AS (PARTITION BY domain), s AS (PARTITION BY suffix)),
domains AS (SELECT DISTINCT domain, domain_n AS n, domain_x AS x, suffix_n, suffix_x FROM hosts),
suffixes AS (SELECT DISTINCT suffix, suffix_n AS n, suffix_x AS x, all_n, all_x FROM hosts),
strengths AS (SELECT {_strength("suffixes", "all")} AS suffix_k, {_strength("domains", "suffix")} AS domain_k, {_strength("hosts", "domain")} AS host_k),
capped AS (SELECT * REPLACE (least(suffix_k, greatest(all_n, 0.5)) AS suffix_k, least(domain_k, greatest(suffix_n, 0.5)) AS domain_k, least(host_k, greatest(domain_n, 0.5)) AS host_k) FROM hosts, strengths),
first AS (SELECT *, (suffix_k * (all_x + 0.5) / (all_n + 1) + suffix_x) / (suffix_k + suffix_n) AS suffix_rate FROM capped WHERE all_n > 0),
second AS (SELECT *, (domain_k * suffix_rate + domain_x) / (domain_k + domain_n) AS domain_rate FROM first),
third AS (SELECT host, (all_x + 0.5) / (all_n + 1) AS mean, (host_k * domain_rate + x) / (host_k + n) AS rate, host_k + n AS weight FROM second),
bad AS (SELECT host FROM third WHERE rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)) > mean)
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL OR host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op11_positional_index": f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
iw AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS phrase, least(len(w), 10) AS size
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (SELECT r, size, p, array_to_string(w[p : p + size - 1], ' ') AS phrase FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM dw, sizes)),
found AS (SELECT r, runs.size, p, item_id FROM runs JOIN windows USING (phrase, size)),
hits AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT r, p, size FROM found)) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM found) WHERE x IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits h USING (r) LEFT JOIN named i USING (r)""",
    "op12_fill_in_middle": """
WITH units AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units),
ends AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
cut AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
        array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM ends),
put AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(o) AS output_sha256, sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN regexp_replace(o, '(?s)^<P>(.*?)<S>(.*?)<M>(.*)$', '\\1\\3\\2') ELSE regexp_replace(o, '(?s)^<S>(.*?)<P>(.*?)<M>(.*)$', '\\2\\3\\1') END) AS restored_sha256 FROM put""",
    "op13_ranked_search": f"""
WITH dt AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
docs AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM dt WHERE len(w) > 0),
size AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM docs),
tfs AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tfs, size GROUP BY term, n_docs),
rules AS (SELECT r, doc_id, 75 + (25 * n * n_docs) // total AS m FROM docs, size),
scores AS (SELECT item_id, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN rules USING (r) GROUP BY ALL),
ranks AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 20""",
}
