"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .licenses import BASE_PHRASES, LOWER, UPPER, WORDS, LicenseRule
from .repetition import DUP_LINE_LIMIT, MIN_WORDS, N_GRAM_LIMITS
from .url_reputation import SECOND_LEVEL, Rule

SPACE = r"[\x20\x09-\x0D]"


def url_reputation_sql(rules: list[Rule], least: float = 1.0, most: float = 1000.0, limit: float = 0.5,
                       z: float = 1.645) -> str:
    order = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.verdict != "block"))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in order]
    rule = " ".join(f"WHEN {f} THEN '{r.text}'" for f, r in zip(fits, order))
    verdict = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, order))
    second = ", ".join(f"'{s}'" for s in SECOND_LEVEL)

    def strength(groups: str, parent: str) -> str:
        return f"""(SELECT coalesce(1 / least(greatest(sum((k - n * {parent}) ** 2 - n * {parent} * (1 - {parent}))
            / nullif(sum(n * {parent} * (1 - {parent}) * (n - 1)), 0), {1 / (1 + most)!r}e0), {1 / (1 + least)!r}e0) - 1,
            {most!r}e0) FROM {groups} WHERE n > 0)"""

    return f"""
WITH u AS (
  SELECT page_id,
         lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
named AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\\.?$', '') AS hk FROM u),
parts AS (SELECT *, string_split(hk, '.') AS l,
                 regexp_matches(hk, '^[0-9]+(\\.[0-9]+){{3}}$') OR contains(hk, '[') AS address FROM named),
sized AS (SELECT *, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN 2 ELSE 1 END AS tail
          FROM parts),
keyed AS (
  SELECT page_id, host, path, hk,
         CASE WHEN address THEN hk ELSE array_to_string(l[-least(tail + 1, len(l)):], '.') END AS domain,
         CASE WHEN address THEN '(address)' ELSE array_to_string(l[-least(tail, len(l)):], '.') END AS suffix
  FROM sized),
outcome AS (SELECT doc_id, max(1 - quality) AS bad FROM labels
            WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT hk, domain, suffix, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
  FROM keyed LEFT JOIN outcome ON page_id = doc_id GROUP BY ALL),
overall AS (SELECT coalesce(sum(n), 0) AS an, coalesce(sum(k), 0) AS ak FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix),
s AS (SELECT s0.*, (ak - k + 1) / (an - n + 2) AS mean FROM s0, overall),
d0 AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY suffix, domain),
d AS (SELECT d0.suffix, d0.domain, d0.n, d0.k, (s.k - d0.k + m * mean) / (s.n - d0.n + m) AS s_rate
      FROM d0 JOIN s ON d0.suffix = s.suffix, (SELECT {strength('s', 'mean')} AS m)),
h AS (SELECT hk, hosts.n, hosts.k, (d.k - hosts.k + m * s_rate) / (d.n - hosts.n + m) AS d_rate
      FROM hosts JOIN d ON hosts.suffix = d.suffix AND hosts.domain = d.domain,
           (SELECT {strength('d', 's_rate')} AS m)),
h2 AS (SELECT hk, k + m * d_rate AS a, n - k + m * (1 - d_rate) AS b FROM h, (SELECT {strength('h', 'd_rate')} AS m)),
low AS (SELECT hk, a / (a + b) - {z!r}e0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM h2)
SELECT page_id, host, path, CASE {rule} END AS rule,
       coalesce(CASE {verdict} END, CASE WHEN low > {limit!r}e0 THEN 'block' ELSE 'allow' END) AS verdict,
       round(low, 6) AS bad_rate_low
FROM keyed JOIN low USING (hk)"""


def repetition_sql() -> str:
    longest = max(N_GRAM_LIMITS)
    leads = ", ".join(f"lead(w, {k}) OVER p AS l{k}" for k in range(1, longest))
    sizes = [3, *N_GRAM_LIMITS]
    grams = ", ".join(f"CASE WHEN i + {n - 1} <= m THEN concat_ws(' ', w, {', '.join(f'l{k}' for k in range(1, n))}) "
                      f"END AS g{n}" for n in sizes)
    dups = ", ".join(f"(g{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, g{n}) > 1)::INT AS d{n}" for n in sizes)
    covers = ", ".join(f"max(d{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) "
                       f"AS c{n}" for n in sizes)
    sums = ", ".join(f"sum(length(w) * c{n}) AS s{n}" for n in N_GRAM_LIMITS)
    outs = ", ".join(f"coalesce(s{n}, 0)::BIGINT AS dup_{n}_gram_chars" for n in N_GRAM_LIMITS)
    over = " OR ".join(f"dup_{n}_gram_chars > {limit!r}e0 * word_chars" for n, limit in N_GRAM_LIMITS.items())
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM t),
words AS (SELECT rid, len(ws) AS m, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
led AS (SELECT *, {leads} FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)),
grams AS (SELECT rid, i, w, {grams} FROM led),
dups AS (SELECT rid, i, w, {dups} FROM grams),
covers AS (SELECT rid, w, {covers} FROM dups),
per_text AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(c3) AS c3, {sums}
             FROM covers GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM t),
same AS (SELECT rid, line, count(*) - 1 AS more FROM lines
         WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid, line),
line_sums AS (SELECT rid, sum(more) AS n, sum(more * length(regexp_replace(line, '{SPACE}', '', 'g'))) AS chars
              FROM same GROUP BY rid),
measured AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n, 0)::BIGINT AS n_dup_lines, coalesce(c3, 0)::BIGINT AS n_repeat_words,
         coalesce(chars, 0)::BIGINT AS dup_line_chars, {outs}
  FROM t LEFT JOIN per_text USING (rid) LEFT JOIN line_sums USING (rid)),
judged AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND NOT (dup_line_chars > {DUP_LINE_LIMIT!r}e0 * word_chars OR {over}) AS kept FROM judged"""


# -- CRC-32 of an ASCII text, byte by byte ---------------------------------------
# ``crc``: one row with the 256 remainders of the reflected polynomial, as a list.
CRC_SQL = """crc_rounds AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_rounds WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM crc_rounds WHERE k = 8)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text expression, with the table ``crc`` in scope."""
    return (f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT), "
            f"lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)")


# -- Merkle manifest ---------------------------------------------------------------
def merkle_sql(levels: int = 8, outer: int = 8) -> str:
    """Eight levels of runs of eight below a subroot, and as many above: 16.7 million rows a group, and groups."""
    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"

    head = "||".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    parts = []
    for side, top, depth in (("g", "lang", levels), ("o", "0", outer)):
        for k in range(depth):
            # runs of level k: their nodes in order, and the level above while there are several nodes
            parts.append(f"""{side}r{k} AS (SELECT gid, i // 8 AS run, list(h ORDER BY i) AS hs, any_value(n) AS n
    FROM {side}{k} WHERE n > 1 GROUP BY gid, i // 8)""")
            parts.append(f"""{side}{k + 1} AS (SELECT gid, run AS i, sha256(array_to_string(hs, '')) AS h,
    (n + 7) // 8 AS n FROM {side}r{k})""")
        ends = " UNION ALL ".join(f"SELECT gid, h FROM {side}{k} WHERE n = 1" for k in range(depth + 1))
        parts.append(f"{side}tops AS ({ends})")
        if side == "g":
            parts.append("""o0 AS (SELECT 0 AS gid, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h,
    count(*) OVER () AS n, gtops.gid AS of FROM gtops JOIN langs ON gtops.gid = langs.gid)""")

    def climb(source: str, side: str, depth: int, gid: str, at: str) -> list[str]:
        """From ``source``'s rows (cur: folded so far, proof: siblings so far) up the levels of one side."""
        out, name = [], source
        for k in range(depth):
            place = f"({at} // {8 ** k}) % 8"
            left = f"array_to_string(r.hs[1:{place}], '')"
            right = f"array_to_string(r.hs[{place} + 2:], '')"
            nxt = f"{source}_{side}{k}"
            out.append(f"""{nxt} AS (SELECT s.* REPLACE (
      CASE WHEN r.hs IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur,
      CASE WHEN r.hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof)
    FROM {name} s LEFT JOIN {side}r{k} r ON r.gid = {gid} AND r.run = {at} // {8 ** (k + 1)})""")
            name = nxt
        return out

    parts += climb("rows", "g", levels, "s.gid", "s.i")
    last = f"rows_g{levels - 1}"
    parts.append(f"""up AS (SELECT s.*, o0.i AS oi, o0.h AS subroot FROM {last} s JOIN o0 ON o0.of = s.gid)""")
    parts += climb("up", "o", outer, "0", "s.oi")
    return f"""
WITH RECURSIVE {CRC_SQL},
base AS (SELECT doc_id, lang, {head} AS head, text, coalesce({crc32_sql("doc_id::VARCHAR")} % 3 = 0, false) AS changed
         FROM documents, crc),
hashed AS (SELECT doc_id, lang, changed, sha256(head || {field("text")}) AS leaf,
                  sha256(head || {field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS tampered
           FROM base),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS gid FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (SELECT doc_id, changed, leaf, tampered, gid,
                  row_number() OVER (PARTITION BY gid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  count(*) OVER (PARTITION BY gid) AS n
           FROM hashed JOIN langs ON hashed.lang IS NOT DISTINCT FROM langs.lang),
g0 AS (SELECT gid, i, leaf AS h, n FROM leaves),
rows AS (SELECT doc_id, leaf, gid, i, CASE WHEN changed THEN tampered ELSE leaf END AS cur, '' AS proof FROM leaves),
{", ".join(parts)}
SELECT doc_id, leaf, subroot, otops.h AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = otops.h AS verified
FROM up_o{outer - 1}, otops"""


# -- conversation repair -----------------------------------------------------------
def repair_sql() -> str:
    """The cheapest edits by a walk over the rows, keeping the least (cost, audit) for each automaton state."""
    c = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    role = "CASE WHEN k = 4 THEN 'user' ELSE coalesce(role, ' ') END"
    text = """CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(coalesce(text, ' '), '.!?', '')
              ELSE coalesce(text, ' ') END"""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    # (from, to, how many insertions lie between)
    ins = "(VALUES (0,0,0),(1,1,0),(2,2,0),(3,3,0),(0,2,1),(0,3,2),(1,2,1),(1,3,2),(2,3,1),(3,2,1)) AS ins(p, q, m)"
    # (from, to, initial of the step)
    steps = "(VALUES (0,1,'s'),(0,2,'u'),(1,2,'u'),(3,2,'u'),(2,3,'a')) AS steps(p, q, r)"
    return f"""
WITH RECURSIVE {CRC_SQL},
kinds AS (SELECT conv_id, turn, role, text, {crc32_sql(f"({c})")} % 20 AS k FROM conversations, crc),
hurt AS (SELECT conv_id, turn, {role} AS role, {text} AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
         FROM kinds WHERE k <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (SELECT g, turn, role, text, row_number() OVER w AS i, rtrim(text, {blanks}) AS t
           FROM hurt JOIN ids ON hurt.conv_id IS NOT DISTINCT FROM ids.conv_id
           WINDOW w AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
judged AS (SELECT *, substr(role, 1, 1) AS s, CASE WHEN t = '' THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN t[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
pairs AS (SELECT *, lag(s) OVER (PARTITION BY g ORDER BY i) || s AS pair FROM judged),
counts AS (SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
           FROM pairs GROUP BY g),
walk AS (
  SELECT g, 0 AS i, q AS st, {{'c': m * 5, 'a': repeat('I', m::BIGINT)}} AS best FROM counts, {ins} WHERE p = 0
  UNION ALL
  SELECT g, any_value(i), q, min(best) FROM (
    SELECT o.g, o.i, ins.q, {{'c': o.c + 5 * m, 'a': o.a || repeat('I', m::BIGINT)}} AS best
    FROM (
      SELECT w.g, j.i, w.st, w.best.c + 2 AS c, w.best.a || 'D' AS a FROM walk w JOIN judged j ON j.g = w.g AND j.i = w.i + 1
      UNION ALL
      SELECT w.g, j.i, steps.q,
             w.best.c + CASE WHEN steps.r = j.s THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END,
             w.best.a || CASE WHEN steps.r = j.s THEN 'K' ELSE 'R' END
      FROM walk w JOIN judged j ON j.g = w.g AND j.i = w.i + 1 JOIN {steps} ON steps.p = w.st
      WHERE (fault IS NULL OR fault = 'truncated') AND (steps.r = j.s OR steps.r <> 's')) o
    JOIN {ins} ON ins.p = o.st) GROUP BY g, q),
done AS (SELECT walk.g, min(best) AS best FROM walk JOIN counts ON walk.g = counts.g AND walk.i = counts.n
         WHERE st IN (0, 3) GROUP BY walk.g),
letters AS (SELECT g, unnest(string_split(best.a, '')) AS e, generate_subscripts(string_split(best.a, ''), 1) AS k FROM done
            WHERE best.a <> ''),
aligned AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM letters
            WINDOW w AS (PARTITION BY g ORDER BY k)),
outs AS (SELECT a.g, a.k, a.e, a.o, j.role, j.text, j.s,
                max(CASE WHEN a.e = 'K' AND j.s = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY a.g) AS sys
         FROM aligned a LEFT JOIN judged j ON j.g = a.g AND j.i = a.i AND a.e <> 'I' WHERE a.e <> 'D'),
hashes AS (SELECT g, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                       || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS h FROM outs GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN counts USING (g) LEFT JOIN done USING (g) LEFT JOIN hashes USING (g)"""


# -- license scan ------------------------------------------------------------------
def license_sql(rules: list[LicenseRule]) -> str:
    values = ",\n".join(f"({i}, '{r.regex}', ' {r.keyword} ', '{r.label}', {r.priority}, {r.confidence!r}e0)"
                        for i, r in enumerate(rules))
    base = "CASE rule " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(BASE_PHRASES.values())) + " END"
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return f"""
WITH rules(rule, p, k, label, priority, confidence) AS (VALUES {values}),
t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '{WORDS}') AS ws FROM documents),
n AS (SELECT rid, doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, '  ') || ' ' AS w FROM t),
gated AS MATERIALIZED (SELECT rid, rule, w, p FROM n JOIN rules ON contains(w, k)),
marked AS (SELECT rid, rule, string_split(trim(regexp_replace(w, p, ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), ' '), '  ') AS ws
           FROM gated WHERE regexp_matches(w, p)),
words AS (SELECT rid, rule, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM marked),
starts AS (SELECT rid, rule, i AS s, row_number() OVER (PARTITION BY rid, rule ORDER BY i) AS m FROM words WHERE starts_with(w, chr(1))),
ends AS (SELECT rid, rule, i + 1 AS e, row_number() OVER (PARTITION BY rid, rule ORDER BY i) AS m FROM words WHERE ends_with(w, chr(2))),
found AS (SELECT rid, rule, s, e, label, priority, confidence FROM starts JOIN ends USING (rid, rule, m) JOIN rules USING (rule)),
kept AS (SELECT * FROM found f WHERE NOT EXISTS (
  SELECT 1 FROM found g WHERE g.rid = f.rid AND g.s <= f.s AND g.e >= f.e
    AND (g.priority > f.priority OR g.priority = f.priority AND (g.e - g.s > f.e - f.s OR g.e - g.s = f.e - f.s AND g.rule < f.rule)))),
based AS (SELECT rid, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, list(DISTINCT {base}) AS ls
          FROM found WHERE rule < {len(BASE_PHRASES)} GROUP BY rid),
own AS (SELECT rid, list(DISTINCT label) AS ls, max(confidence) AS score FROM kept GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(array_to_string(list_sort(based.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.ls, []), coalesce(own.ls, [])))), ','), '') AS labels,
       coalesce(score, 0e0) AS score
FROM n LEFT JOIN based USING (rid) LEFT JOIN own USING (rid)"""


# -- source mixture ----------------------------------------------------------------
def mixture_sql(weights: dict[str, dict[str, float]], domains: int, max_epochs: int = 4, seed: int = 42) -> str:
    """Budgets by water-filling over domain, language and source; then the cut in each leaf's partial epoch."""
    levels, parts = ["domain", "lang", "source"], []
    for k, level in enumerate(levels):
        path, above = ", ".join(levels[:k + 1]), ", ".join(levels[:k]) or "0"
        own = " ".join(f"WHEN {level} = '{x}' THEN {float(v)!r}e0" for x, v in weights.get(level, {}).items())
        weight = f"CASE {own} ELSE 1e0 END" if own else "1e0"
        source = f"b{k}"
        same = " AND ".join(f"{source}.{p} IS NOT DISTINCT FROM s{k}.{p}" for p in levels[:k + 1])
        parts.append(f"""n{k} AS (SELECT {path}, sum(supply) AS supply, any_value(budget) AS budget, {weight} AS weight
    FROM {source} GROUP BY {path}),
w{k} AS (SELECT *, CASE WHEN supply <= 0 THEN 0e0
    WHEN max(CASE WHEN supply > 0 THEN weight ELSE 0e0 END) OVER (PARTITION BY {above}) > 0 THEN greatest(weight, 1e-12)
    ELSE 1e0 END AS w FROM n{k}),
q{k} AS (SELECT *, CASE WHEN w > 0 THEN supply / w ELSE 0e0 END AS ratio FROM w{k}),
l{k} AS (SELECT *, greatest(budget - coalesce(sum(supply) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0), 0e0)
    / sum(w) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM q{k}
    WINDOW q AS (PARTITION BY {above} ORDER BY ratio, {level} NULLS FIRST)),
f{k} AS (SELECT *, min((ratio <= coalesce(level, 0e0))::INT) OVER (PARTITION BY {above} ORDER BY ratio, {level} NULLS FIRST
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS fits FROM l{k}),
c{k} AS (SELECT *, first_value(CASE WHEN fits THEN NULL ELSE level END IGNORE NULLS) OVER (PARTITION BY {above}
    ORDER BY ratio, {level} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM f{k}),
s{k} AS (SELECT {path}, CASE WHEN fits THEN supply ELSE least(w * common, supply) END AS share FROM c{k}),
b{k + 1} AS (SELECT {source}.* REPLACE (share AS budget) FROM {source} JOIN s{k} ON {same})""")
    leaf = " AND ".join(f"d.{p} IS NOT DISTINCT FROM x.{p}" for p in levels)
    return f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, 'd' || ({crc32_sql("coalesce(source, '')")} % {domains}) AS domain,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
             md5('{seed}:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '-')) AS base FROM documents, crc),
b0 AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, sum(n)::DOUBLE * {max_epochs} AS supply,
              (SELECT sum(n)::DOUBLE FROM d) AS budget FROM d GROUP BY domain, lang, source),
{", ".join(parts)},
x0 AS (SELECT * REPLACE (round(budget)::BIGINT AS budget) FROM b{len(levels)}),
x AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole FROM x0),
o AS (SELECT d.*, x.whole, x.budget - x.whole * x.tokens AS rest,
             CAST('0x' || substr(md5(x.whole::VARCHAR || ':' || base), 1, 15) AS BIGINT) AS h FROM d JOIN x ON {leaf}),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, rid
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, lang, source,
       (whole + CASE WHEN n > 0 AND before + n <= rest THEN 1
                     WHEN n = 0 AND h < max(CASE WHEN before < rest THEN h END) OVER (PARTITION BY domain, lang, source) THEN 1
                     ELSE 0 END)::INT AS epochs,
       CASE WHEN n > 0 AND before < rest AND before + n > rest THEN rest - before ELSE 0 END::BIGINT AS part_tokens
FROM p"""
