"""DuckDB SQL for the queries that SQL can express, over whole tables.

Language, toxicity, decontamination, language-model, secret and alignment queries learn models, search by edit distance, report
places of matches or run tokenizers; they have none and are tested otherwise.
"""

from __future__ import annotations

from clipsift.llm.urlfilter import LOWER, RULES, SECOND_LEVEL, UPPER

WORDS = r"[^\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORDS}')"


def _hash32(parts: str) -> str:
    return f"CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT)"


def _extra(at: str) -> str:
    """Words in blocks of the extra choice among a shard's first `at` words."""
    chosen = lambda b: f"(({b}) * (quota % b1) + start) // b1"
    return f"({chosen(f'{at} // 16')} * 16 + ({at} % 16) * ({chosen(f'{at} // 16 + 1')} - {chosen(f'{at} // 16')}))"


#: Every quotient of every unit is ranked here; the operator ranks only those that can be decisive.
MIXING = f"""WITH sized AS (SELECT doc_id, source, CAST(coalesce(len({_words('text')}), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS goal FROM src),
lv AS (SELECT *, cap / weight AS ratio, (goal - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT *, coalesce(least(cap, weight * (arg_min(level, ratio) FILTER (ratio > level) OVER ())), cap) AS target FROM lv),
sq AS (SELECT rank, target / (2 * k + 1) AS q, k, CAST(floor(goal / 16 + 0.5) AS BIGINT) AS seats FROM tg, LATERAL (SELECT unnest(range(2 * ((source_size + 15) // 16))) AS k)),
ss AS (SELECT rank, count(*) AS seats FROM (SELECT * FROM sq QUALIFY row_number() OVER (ORDER BY q DESC, rank, k) <= seats) GROUP BY rank),
dealt AS (SELECT sized.*, tg.rank, source_size, target, {_hash32("coalesce(CAST(doc_id AS VARCHAR), '') || ':11'")} % greatest((source_size + 999999) // 1000000, 1) AS shard
  FROM sized JOIN tg ON sized.source IS NOT DISTINCT FROM tg.source),
sh AS (SELECT rank, shard, CAST(sum(size) AS BIGINT) AS shard_size, (CAST(sum(size) AS BIGINT) + 15) // 16 AS blocks FROM dealt GROUP BY rank, shard),
hq AS (SELECT sh.rank, shard, k, CAST(shard_size AS DOUBLE) / (2 * k + 1) AS q, coalesce(seats, 0) AS seats FROM sh LEFT JOIN ss ON sh.rank = ss.rank, LATERAL (SELECT unnest(range(2 * blocks)) AS k)),
hs AS (SELECT rank, shard, count(*) AS quota FROM (SELECT * FROM hq QUALIFY row_number() OVER (PARTITION BY rank ORDER BY q DESC, shard, k) <= seats) GROUP BY rank, shard),
qt AS (SELECT sh.rank, sh.shard, greatest(blocks, 1) AS b1, coalesce(quota, 0) AS quota, CASE WHEN blocks > 0 THEN {_hash32("concat_ws(':', sh.rank, sh.shard, '11')")} % blocks ELSE 0 END AS start
  FROM sh LEFT JOIN hs ON sh.rank = hs.rank AND sh.shard = hs.shard),
pl AS (SELECT dealt.*, b1, quota, start, CAST(sum(size) OVER (PARTITION BY dealt.rank, dealt.shard ORDER BY md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e
  FROM dealt JOIN qt ON dealt.rank = qt.rank AND dealt.shard = qt.shard)
SELECT doc_id, size, source_size, target, CAST(size * (quota // b1) + {_extra('e')} - {_extra('(e - size)')} AS BIGINT) AS taken FROM pl"""


def _rule() -> str:
    found = []
    for rule, _ in sorted(RULES, key=lambda r: -len(r[0])):
        host, slash, rest = rule.partition("/")
        found.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{slash}{rest}') THEN '{rule}'")
    return f"CASE {' '.join(found)} END"


def _strength(units: str) -> str:
    """(mean, k) of (n, bad) rows by moments, k between 1 and 1000."""
    return f"""(SELECT mean, CASE WHEN mean IS NULL THEN 1 WHEN v - s * inv > 0 THEN least(1000, greatest(1, (s - v) / (v - s * inv))) ELSE 1000 END AS k
  FROM (SELECT *, mean * (1 - mean) AS s FROM (SELECT CAST(sum(bad) AS DOUBLE) / sum(n) AS mean, var_pop(CAST(bad AS DOUBLE) / n) AS v, avg(CAST(1 AS DOUBLE) / n) AS inv FROM {units} WHERE n > 0)))"""


URLS = rf"""WITH parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {_rule()} AS rule FROM parsed),
said AS (SELECT *, CASE {' '.join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)} END AS said FROM ruled),
two AS (SELECT host, count(said) AS n, count(*) FILTER (said = 'block') AS bad, regexp_extract(host, '(?:\A|\.)((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})\z', 1) AS two, string_split(host, '.') AS l FROM said GROUP BY host),
sfx AS (SELECT *, CASE WHEN two <> '' THEN two ELSE l[-1] END AS suffix, CASE WHEN two <> '' THEN 3 ELSE 2 END AS labels FROM two),
hosts AS (SELECT *, CASE WHEN len(l) <= labels THEN host ELSE array_to_string(l[-labels:], '.') END AS domain FROM sfx),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
ks AS {_strength('suffixes')}, kd AS {_strength('domains')}, kh AS {_strength('hosts')},
sm AS (SELECT suffix, (bad + k * coalesce(mean, 0.5)) / (n + k) AS m FROM suffixes, ks),
dm AS (SELECT suffix, domain, (bad + k * m) / (n + k) AS m FROM domains JOIN sm USING (suffix), kd),
hm AS (SELECT host, n, k, (bad + k * m) / (n + k) AS m FROM hosts JOIN dm USING (suffix, domain), kh)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN m - 1.64 * sqrt(m * (1 - m) / (n + k + 1)) > 0.9 THEN 'block' ELSE 'allow' END) AS verdict FROM said JOIN hm USING (host)"""

SUBSTRING = f"""WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS p)),
later AS (SELECT doc_id, p FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
c AS (SELECT x.doc_id, x.p, word, coalesce(max(CASE WHEN later.p IS NOT NULL THEN 1 END) OVER (PARTITION BY x.doc_id ORDER BY x.p ROWS 19 PRECEDING), 0) AS gone FROM x LEFT JOIN later ON x.doc_id = later.doc_id AND x.p = later.p),
k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
t AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM t),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT u, v FROM links UNION SELECT r.u, links.v FROM r JOIN links ON r.v = links.u),
least AS (SELECT u, min(v) AS m FROM r GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM t LEFT JOIN least ON doc_id = u"""


def _tree(text: str) -> str:
    return f"list_transform(string_split({text}, chr(10)), lambda p: array_to_string(list_transform(regexp_extract_all(p, '(?s).{{1,24}}'), lambda x: substr(md5(x), 1, 16)), ''))"


def _sections(tree: str) -> str:
    return f"array_to_string(list_transform(range(1, len({tree}) + 1, 8), lambda i: substr(sha256(array_to_string({tree}[i:i + 7], '.')), 1, 16)), ',')"


def _print(tree: str, parts: str) -> str:
    return f"sha256({parts}) || '|' || {parts} || '|' || array_to_string({tree}, '.')"


def _digests(tree: str) -> str:
    return f"list_distinct(regexp_extract_all(array_to_string({tree}, '.'), '[0-9a-f]{{16}}'))"


def _near(a: str, b: str) -> str:
    return f"CASE WHEN greatest(len({a}), len({b})) = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / greatest(len({a}), len({b})) END"


def _same(a: str, b: str) -> str:
    """Entries in common at the beginning of two lists."""
    return f"coalesce(list_position(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] <> {b}[i]), true) - 1, least(len({a}), len({b})))"


FINGERPRINTS = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next FROM t),
e AS (SELECT *, length(text) AS n_chars, substr(text, 1, length(text) - length(text) // 3) || substr(next, 1, length(text) // 3) AS edited FROM n),
l AS (SELECT *, {_tree('text')} AS a, {_tree('edited')} AS b, {_tree('next')} AS c FROM e),
s AS (SELECT *, {_sections('a')} AS sa, {_sections('b')} AS sb, {_digests('a')} AS da, {_digests('b')} AS db, {_digests('c')} AS dc, {_same('a', 'b')} AS f, {_same('list_reverse(a)', 'list_reverse(b)')} AS z FROM l),
m AS (SELECT *, least(z, least(len(a), len(b)) - f) AS z1 FROM s),
i AS (SELECT *, list_distinct(a[f + 1:len(a) - z1]) AS ia, list_distinct(b[f + 1:len(b) - z1]) AS ib FROM m)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, {_print('a', 'sa')} AS fingerprint, {_print('b', 'sb')} AS edited_fingerprint, {_near('da', 'db')} AS near_edited, {_near('da', 'dc')} AS near_next,
  CAST(f AS BIGINT) AS edit_first, CAST(len(a) - z1 AS BIGINT) AS edit_end, CAST(len(ib) - len(list_intersect(ia, ib)) AS BIGINT) AS n_new, CAST(len(ia) - len(list_intersect(ia, ib)) AS BIGINT) AS n_gone FROM i"""

_ESCAPES = lambda t: f"(len(regexp_extract_all({t}, '[\\\\]|</turn>')) + coalesce(list_sum(list_transform(regexp_extract_all({t}, '###+'), lambda x: length(x) - 2)), 0))"

CHAT = f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
m AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM c),
k AS (SELECT *, md5(length(r) || ':' || r || t) AS k FROM m),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, r, k)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, r, k) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(r) + {_ESCAPES('r')} + len(regexp_extract_all(r, ':')) + 2 + length(t) + {_ESCAPES('t')} + 8) AS formatted_chars FROM k GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _crc32(digits: str) -> str:
    """Unsigned crc32 of ASCII characters, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT for z in range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)"
    return f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({digits}, ''), lambda x: ascii(x)::UBIGINT)), lambda c, b: {bits}))"


def _levels(name: str, begin: str) -> str:
    """All levels above (tree, pos, d): every three nodes become one until one is left; `n` nodes are on a level."""
    return f"""{name} AS (SELECT 0 AS level, tree, pos, d, count(*) OVER (PARTITION BY tree) AS n FROM {begin}
  UNION ALL SELECT level + 1, tree, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY level, tree, pos // 3)"""


def _steps(name: str, nodes: str, begin: str, first: int) -> str:
    """Of every (tree, pos), by level from `first` on: the siblings of its ancestor, those before and those after it."""
    at = "b.pos // CAST(pow(3, s.level) AS BIGINT)"
    side = lambda way: f"coalesce(string_agg(s.d, '' ORDER BY s.pos) FILTER (s.pos {way} {at}), '')"
    return f"{name} AS (SELECT b.tree, b.pos, s.level + {first} AS level, {side('<')} AS l, {side('>')} AS r FROM {begin} b JOIN {nodes} s ON s.tree = b.tree AND s.n > 1 AND s.pos // 3 = {at} // 3 GROUP BY b.tree, b.pos, s.level)"


MANIFEST = f"""WITH RECURSIVE docs AS (SELECT doc_id, source, {_leaf('text')} AS d, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS claim FROM documents),
base AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM docs),
{_levels('nodes', 'base')},
subroots AS (SELECT 0 AS tree, tree AS pos, d FROM nodes WHERE n = 1),
{_levels('upper', 'subroots')},
{_steps('low', 'nodes', 'base', 0)},
{_steps('high', 'upper', 'subroots', 1000)},
steps AS (SELECT * FROM low UNION ALL SELECT base.tree, base.pos, level, l, r FROM base JOIN high ON high.pos = base.tree),
proofs AS (SELECT tree, pos, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM steps GROUP BY tree, pos),
folded AS (SELECT doc_id, base.d AS leaf, s.d AS subroot, (SELECT d FROM upper WHERE n = 1) AS root, coalesce(path, []) AS path, claim FROM base JOIN subroots s ON s.pos = base.tree LEFT JOIN proofs p ON p.tree = base.tree AND p.pos = base.pos),
done AS (SELECT *, list_reduce(list_prepend({{'l': claim, 'r': ''}}, path), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root FROM folded)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done"""

ORACLES: dict[str, str] = {
    "op1_mixing": MIXING,
    "op4_urls": URLS,
    "op6_substring_dedup": SUBSTRING,
    "op7_jaccard": JACCARD,
    "op8_fingerprints": FINGERPRINTS,
    "op12_chat": CHAT,
    "op13_manifest": MANIFEST,
}
