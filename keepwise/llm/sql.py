"""DuckDB SQL that recomputes the operators SQL can express."""

from __future__ import annotations

from keepwise.llm import conversation_edits as E
from keepwise.llm import quality_rules as Q
from keepwise.llm import rendezvous as R
from keepwise.llm import url_reputation as U
from keepwise.llm import warc as W

WS = r"[\x20\x09-\x0D]"


def _rule_sql(rule: str, cutoff: str) -> str:
    num, den, op, _ = Q.RULES[rule]
    return f"100 * {num} {op} ({cutoff}) * {den}"


def quality_counts(table: str = "documents") -> str:
    """CTEs up to ``counts``: doc_id, stratum and the counts of every rule."""
    return rf"""
    d AS (SELECT row_number() OVER () AS k, doc_id, lang AS stratum, coalesce(text, '') AS t FROM {table}),
    w AS (SELECT k, doc_id, stratum, t, list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '') AS w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    win AS (SELECT k, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
            FROM (SELECT k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
    rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i+1, i+2]) AS p FROM rep) GROUP BY k),
    counts AS (SELECT w.k, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
                      CAST(length(regexp_replace(t, '{WS}', '', 'g')) AS BIGINT) AS word_chars,
                      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                      CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
                      CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
                      len(w) < {Q.MIN_WORDS} OR 100 * coalesce(cov.n, 0) > {Q.MAX_REPEAT_PCT} * len(w) AS base_failed
               FROM w LEFT JOIN cov ON w.k = cov.k)"""


def quality_cutoffs(alpha: float = Q.ALPHA, delta: float = Q.DELTA) -> str:
    a, rules = alpha / len(Q.RULES), len(Q.RULES)
    cells = " UNION ALL ".join(
        f"SELECT stratum, '{r}' AS rule, {i} AS step, {c} AS cutoff, count(*) AS n, CAST(count_if({_rule_sql(r, str(c))}) AS BIGINT) AS x "
        f"FROM held GROUP BY stratum" for r, (_, _, _, grid) in Q.RULES.items() for i, c in enumerate(grid))
    return f"""
    good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
    held AS (SELECT * FROM counts WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
    cells AS ({cells}),
    tail AS (SELECT *, CASE WHEN x >= n * {a!r} THEN 1.0 ELSE list_sum(list_transform(generate_series(0, x), lambda i:
                exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({a!r}) + (n - i) * ln({1 - a!r})))) END AS p
             FROM cells),
    cut AS (SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM tail
            WHERE p <= {delta!r} / ({rules} * (SELECT count(*) FROM (SELECT DISTINCT stratum FROM counts)))
            GROUP BY stratum, rule)"""


def quality_judged() -> str:
    hits = ", ".join(
        f"CASE WHEN {_rule_sql(r, f'''SELECT cutoff FROM cut WHERE rule = '{r}' AND cut.stratum IS NOT DISTINCT FROM counts.stratum''')} "
        f"THEN '{r}' END" for r in Q.RULES)
    return f"""
    judged AS (SELECT *, array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',') AS rejected_by FROM counts)"""


QUALITY_RULES = f"""WITH {quality_counts()}, {quality_cutoffs()}, {quality_judged()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM judged"""


def _url_reputation() -> str:
    levels, up = [], "CROSS JOIN (SELECT sum(n) AS n_up, sum(x) AS x_up, 0.5::DOUBLE AS m_up FROM hosts) CROSS JOIN (SELECT 1.0::DOUBLE AS k)"
    for i, level in enumerate(U.LEVELS):
        keys = ", ".join(U.LEVELS[: i + 1])
        if i:
            parent = U.LEVELS[i - 1]
            up = (f"JOIN (SELECT {', '.join(U.LEVELS[:i])}, n AS n_up, x AS x_up, m AS m_up FROM g_{parent}) "
                  f"USING ({', '.join(U.LEVELS[:i])}) CROSS JOIN k_{parent}")
        levels.append(f"""
    g_{level} AS (SELECT {keys}, n, x, n_up, (m_up * k + x_up - x) / (k + n_up - n) AS m
        FROM (SELECT {keys}, sum(n)::DOUBLE AS n, sum(x)::DOUBLE AS x FROM hosts GROUP BY {keys}) {up}),
    s_{level} AS (SELECT sum((x - n * m) ** 2 / n) AS s, sum(m * (1 - m)) AS v, sum(n * m * (1 - m)) AS nv FROM g_{level} WHERE n > 0),
    k_{level} AS (SELECT CASE WHEN nv IS NULL OR nv <= 0 THEN 100.0 WHEN rho > 1e-4 THEN greatest((1 - rho) / rho, {U.MIN_STRENGTH!r})
        ELSE 9999.0 END::DOUBLE AS k FROM (SELECT nv, CASE WHEN nv - v > 0 THEN (s - v) / (nv - v) ELSE 0.0 END AS rho FROM s_{level}))""")
    x, terms, seconds = repr(U.MAX_BAD), U.TERMS, ", ".join(f"'{w}'" for w in U.SECOND_LEVELS)
    term = lambda n: (f"exp(lgamma(a + b + {n}) - lgamma(a + 1 + {n}) - lgamma(b) + (a + {n}) * ln({x}) + b * ln(1 - {x}))")
    rule = lambda what: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'rule' else v}'"
        for v, h, p in sorted(U.RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    return rf"""WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
    p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    o AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
    c AS (SELECT page_id, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '\.$', '') AS host FROM p),
    l AS (SELECT *, string_split(host, '.') AS w, regexp_matches(host, '^[0-9.]+$|^\[') AS digits FROM c),
    t AS (SELECT *, len(w) > 2 AND length(w[-1]) = 2 AND w[-2] IN ({seconds}) AS two FROM l),
    hosts AS (SELECT CASE WHEN digits THEN host ELSE array_to_string(CASE WHEN two THEN w[-2:] ELSE w[-1:] END, '.') END AS suffix,
                     CASE WHEN digits THEN host ELSE array_to_string(CASE WHEN two THEN w[-3:] ELSE w[-2:] END, '.') END AS domain, host,
                     count(quality) AS n, coalesce(sum(1 - quality), 0) AS x
              FROM t LEFT JOIN o ON page_id = doc_id GROUP BY ALL),{','.join(levels)},
    ab AS (SELECT host, n_up, m * k + x AS a, (1 - m) * k + n - x AS b FROM g_host, k_host),
    bad AS (SELECT host FROM ab WHERE n_up > 0 AND {x} * (a + b) < a
            AND round(list_sum(list_transform(range(0, {terms}), lambda n: {term('n')}))
                      + {term(terms)} / (1 - greatest({x} * (a + b + {terms}) / (a + 1 + {terms}), {x})), 9) <= {U.RISK!r})
SELECT page_id, host, path, {rule('rule')} AS rule,
       coalesce({rule('verdict')}, CASE WHEN regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '\.$', '') IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM p"""


URL_REPUTATION = _url_reputation()

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    k AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
    r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {W.MIN_REVISIT} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {W.MIN_REVISIT} AND page_id > first_id THEN first_id END AS refers_to FROM r"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED_SEARCH = rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    tok AS (SELECT k, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM d),
    tfs AS (SELECT k, term, count(*) AS tf FROM tok GROUP BY ALL),
    len AS (SELECT k, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY k),
    tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM len),
    wts AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
            FROM tfs, (SELECT docs FROM tot) GROUP BY term),
    imp AS (SELECT k, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS v
            FROM tfs JOIN len USING (k) JOIN wts USING (term), tot),
    b AS (SELECT row_number() OVER () AS q, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
    ask AS (SELECT q, item_id, unnest(regexp_extract_all(t, '{TERM}')) AS term FROM b),
    s AS (SELECT q, item_id, k, CAST(sum(v) AS BIGINT) AS score FROM ask JOIN imp USING (term) GROUP BY ALL HAVING sum(v) > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s JOIN d USING (k))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

def _crc_table() -> list[int]:
    """The table of CRC-32 (reflected polynomial 0xEDB88320), by its rule."""
    out = list(range(256))
    for _ in range(8):
        out = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a UTF-8 text, byte by byte."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    table = f"CAST({_crc_table()} AS BIGINT[])"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
            f"lambda c, b: xor({table}[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)")


def _rendezvous() -> str:
    def winner(shards: dict) -> str:
        waits = ", ".join(f"{{'wait': -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|{s}'), 1, {R.DRAW_BITS // 4}) AS BIGINT) + 0.5) "
                          f"/ {float(1 << R.DRAW_BITS)!r}) / {w!r}, 'shard': {s}}}" for s, w in sorted(shards.items()))
        return f"list_min([{waits}]).shard"

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {winner(R.SHARDS)} AS shard, {winner({**R.SHARDS, max(R.SHARDS) + 1: 1.0})} AS grown_shard FROM documents)
SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, {crc32_sql('t')} AS text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, grown_shard FROM d"""


RENDEZVOUS = _rendezvous()


def _conversation_repair() -> str:
    """The cheapest edits from the end of a conversation backwards: per row and state the best of up to two
    inserted turns and the row's edit before what is best after it. Nothing is searched, so it says what the
    search has to find."""
    step, states = [], range(4)
    for s in states:
        at, lines = s, []
        for k in range(3):
            head = f"({s}, '{'I' * k}', {k * E.INSERT}, [{', '.join(repr(x) for x in lines)}]::VARCHAR[]"
            step.append(f"{head}, 'D', '', '', {at})")
            step += [f"{head}, 'K', '{i}', '', {to})" for i, to in E.NEXT[at].items()]
            step.append(f"{head}, 'R', '', '{E.ROLE[at]}', {E.TURN[at]})")
            lines, at = [*lines, E.ROLE[at] + ":"], E.TURN[at]
    key = crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    pairs = ", ".join(f"'{x}'" for x in sorted(E.LEGAL_PAIRS))
    return f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} % 20 AS d,
                  dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM conversations),
    hurt AS (SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                    CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                    unnest(CASE WHEN d = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE d <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
                      right(rtrim(text, {space}), 1) AS e, left(role, 1) AS init FROM hurt),
    told AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
                            WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                    lag(init) OVER (PARTITION BY c ORDER BY pos) AS prior FROM placed),
    facts AS (SELECT c, max(pos) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                     count_if(prior IS NOT NULL AND prior || init NOT IN ({pairs})) AS illegal FROM told GROUP BY c),
    step(s, ins, ins_cost, ins_lines, edit, init, role, s2) AS (VALUES {', '.join(step)}),
    best AS (
        SELECT c, n AS pos, s, x AS b FROM facts, (VALUES ({E.START}, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}}),
            ({E.SYSTEM}, {{'cost': 4, 'audit': 'II', 'lines': ['user:', 'assistant:']}}), ({E.USER}, {{'cost': 2, 'audit': 'I', 'lines': ['assistant:']}}),
            ({E.ASSISTANT}, {{'cost': 0, 'audit': '', 'lines': []::VARCHAR[]}})) v(s, x)
        UNION ALL
        SELECT c, pos - 1, s, min(b) FROM (
            SELECT best.c, best.pos, t.s, {{'cost': t.ins_cost + CASE t.edit WHEN 'D' THEN {E.DELETE} WHEN 'R' THEN {E.REROLE} ELSE 0 END
                                             + CASE WHEN t.edit <> 'D' AND r.fault = 'truncated' THEN {E.SHORT} ELSE 0 END + best.b.cost,
                                           'audit': t.ins || t.edit || best.b.audit,
                                           'lines': list_concat(list_concat(t.ins_lines, CASE t.edit WHEN 'D' THEN []::VARCHAR[]
                                               WHEN 'K' THEN [r.role || ':' || r.text] ELSE [t.role || ':' || r.text] END), best.b.lines)}} AS b
            FROM best JOIN told r ON r.c = best.c AND r.pos = best.pos JOIN step t ON t.s2 = best.s
                 AND (t.edit = 'D' OR (r.fault NOT IN ('blank', 'duplicate') AND (t.edit = 'R' OR t.init = r.init)))) GROUP BY c, pos, s),
    found AS (SELECT c, b FROM best WHERE pos = 0 AND s = {E.START})
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(found.b.cost, 0) AS BIGINT) AS cost,
       coalesce(found.b.audit, '') AS audit, sha256(coalesce(array_to_string(found.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM raw) k LEFT JOIN facts ON facts.c = k.c LEFT JOIN found ON found.c = k.c"""


CONVERSATION_REPAIR = _conversation_repair()
