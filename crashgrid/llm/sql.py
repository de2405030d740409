"""Reference SQL of the operators that SQL can express."""

from __future__ import annotations

from crashgrid.llm.url_filters import DEEP_SUFFIXES, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_PRIOR = """
    SELECT p, CASE WHEN n0 = 0 THEN 2.0 WHEN p * (1 - p) <= 0 OR room <= 0 THEN 1e6
                   ELSE 1 / least(greatest((ffn - n0 * p * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * room), 1e-6), 0.999) - 1 END AS m
    FROM (SELECT *, CASE WHEN n0 = 0 THEN 0.5 ELSE f / n0 END AS p, n0 - nn / n0 - (k - 1) AS room
          FROM (SELECT count(*) AS k, coalesce(sum(n)::DOUBLE, 0) AS n0, sum(bad)::DOUBLE AS f, sum(n::DOUBLE * n) AS nn,
                       sum(bad::DOUBLE * bad / n) AS ffn FROM {groups} WHERE n > 0))
"""

OP1 = f"""
WITH w AS (SELECT rowid AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS words FROM
           (SELECT row_number() OVER () AS rowid, * FROM documents)),
g AS (SELECT r, i, list_slice(words, i, i + 4) AS s FROM
      (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM d, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(words) AS n_words, len(array_to_string(words, '')) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
             len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
             - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c ON w.r = c.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
prior AS ({_PRIOR.format(groups="h")})
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce((h.bad + p * m) / (h.n + m), 0) <= 0.5 AS kept
FROM f LEFT JOIN h ON f.source = h.source, prior
"""

_RULES = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
_DEEP = ", ".join(f"'{s}'" for s in DEEP_SUFFIXES)
_FROM_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3 = f"""
WITH u AS (SELECT page_id, row_number() OVER () AS r,
             translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_FROM_UPPER}) AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN toxic IS NULL OR quality IS NULL THEN NULL ELSE 0 END) AS bad
      FROM labels GROUP BY doc_id),
h AS (SELECT host, count(l.bad) AS n, coalesce(sum(l.bad), 0) AS bad FROM u LEFT JOIN l ON u.page_id = l.doc_id
      WHERE host <> '' GROUP BY host),
s AS (SELECT *, string_split(host, '.') AS parts FROM h),
t AS (SELECT host, n, bad, parts, CASE WHEN len(parts) > 2 AND array_to_string(parts[-2:], '.') IN ({_DEEP})
        THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix FROM s),
hosts AS (SELECT host, n, bad, suffix, CASE WHEN len(parts) < len(string_split(suffix, '.')) + 1 THEN host
        ELSE array_to_string(parts[-(len(string_split(suffix, '.')) + 1):], '.') END AS domain FROM t),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
ps AS ({_PRIOR.format(groups="suffixes")}), pd AS ({_PRIOR.format(groups="domains")}), ph AS ({_PRIOR.format(groups="hosts")}),
rs AS (SELECT suffix, (bad + ps.p * ps.m) / (n + ps.m) AS rate FROM suffixes, ps),
rd AS (SELECT domain, (bad + rs.rate * pd.m) / (n + pd.m) AS rate FROM domains JOIN rs USING (suffix), pd),
rh AS (SELECT host, (bad + rd.rate * ph.m) / (n + ph.m) AS rate, n + ph.m + 1 AS trials FROM hosts JOIN rd USING (domain), ph),
k AS (SELECT host, greatest(0, rate - 1.645 * sqrt(rate * (1 - rate) / trials)) > 0.5 AS bad FROM rh),
f AS (SELECT r, max_by(rule, len(rule)) AS rule, max_by(verdict, len(rule)) AS verdict
      FROM u JOIN (VALUES {_RULES}) AS x(verdict, rule, name, prefix)
        ON (u.host = name OR ends_with(u.host, '.' || name)) AND starts_with(u.path, prefix) GROUP BY r)
SELECT page_id, u.host, path, f.rule, coalesce(f.verdict, CASE WHEN k.bad THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON u.r = f.r LEFT JOIN k ON u.host = k.host
"""

OP11 = fr"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(coalesce(text, ''), {_FROM_UPPER}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(list_slice(words, i, i + m - 1), ' ') AS phrase FROM
      (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
x AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE m > 1),
k AS (SELECT lang, phrase, m, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k+1:], ' ') AS tail FROM
      (SELECT *, unnest(range(1, m)) AS k FROM x)),
s AS (SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, ((2000000::HUGEINT * k.a) // (l.a + r.a))::BIGINT AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.head JOIN f r ON r.lang = k.lang AND r.phrase = k.tail),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(words[i:i+j-1], ' ') AS phrase, max(a) AS longer FROM
      (SELECT *, unnest(range(1, m - j + 2)) AS i FROM x, (SELECT unnest([2, 3]) AS j) WHERE j < m) GROUP BY ALL),
o AS (SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
      FROM c LEFT JOIN i ON c.lang = i.lang AND c.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * c.a)
SELECT o.lang, rank, phrase, a, l, r, n.n, score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
"""

_SHOWN = r"regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?TURN|/?s>)', '\1\2\\\3', 'g')"

OP12 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
           (SELECT conv_id, turn, role, text FROM conversations UNION ALL
            SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')))),
f AS (SELECT *, length({_SHOWN}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE length(role) + 16 END AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(shown))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

ORACLES = {"op1_quality_rules": OP1, "op3_url_filters": OP3, "op11_collocations": OP11, "op12_chat_formatting": OP12}
