"""What the queries must equal, as SQL."""

from __future__ import annotations

from rondas.llm import decontamination as D
from rondas.llm import hosttrust as H
from rondas.llm import licences as L
from rondas.llm import merkle as M
from rondas.llm import poisson as P
from rondas.llm import repetition as R
from rondas.llm import search as Q

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _covered(n: int) -> str:
    """Words of each text inside an n-gram that occurs twice in it: (r, i)."""
    return f"""
    grams_{n} AS (
        SELECT r, i, count(*) OVER (PARTITION BY r, g) > 1 AS twice
        FROM (SELECT r, unnest(range(1, n_words - {n} + 2)) AS i,
                     unnest(list_transform(range(1, n_words - {n} + 2), lambda x: array_to_string(ws[x:x + {n} - 1], ' '))) AS g
              FROM texts WHERE n_words >= {n})),
    covered_{n} AS (
        SELECT r, count(*) AS n, sum(length(ws[j])) AS chars
        FROM (SELECT DISTINCT r, unnest(range(i, i + {n})) AS j FROM grams_{n} WHERE twice) JOIN texts USING (r)
        GROUP BY r)"""


def repetition_rules() -> str:
    lengths = sorted({*R.GRAM_LIMITS, R.WINDOW})
    gram_columns = ", ".join(f"coalesce(covered_{n}.chars, 0)::BIGINT AS gram_{n}" for n in R.GRAM_LIMITS)
    joins = " ".join(f"LEFT JOIN covered_{n} USING (r)" for n in lengths)
    over = " OR ".join(f"100 * gram_{n} > {limit} * word_chars" for n, limit in R.GRAM_LIMITS.items())
    return rf"""
    WITH texts AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS ws, len({WORDS}) AS n_words
        FROM documents),
    {",".join(_covered(n) for n in lengths)},
    lines AS (
        SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
    line_sums AS (
        SELECT r, sum(n - 1) AS n_dup_lines,
               sum((n - 1) * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS line_chars
        FROM lines GROUP BY r),
    counted AS (
        SELECT doc_id, n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
               (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
               coalesce(covered_{R.WINDOW}.n, 0)::BIGINT AS n_repeat_words,
               coalesce(line_chars, 0)::BIGINT AS line_chars, {gram_columns}
        FROM texts LEFT JOIN line_sums USING (r) {joins})
    SELECT *, n_words < {R.MIN_WORDS} OR 100 * n_repeat_words > {R.WINDOW_LIMIT} * n_words AS base_failed,
           NOT (n_words < {R.MIN_WORDS} OR 100 * n_repeat_words > {R.WINDOW_LIMIT} * n_words
                OR 100 * line_chars > {R.LINE_LIMIT} * word_chars OR {over}) AS kept
    FROM counted"""


def host_trust() -> str:
    small = f"translate(%s, '{H.UPPER}', '{H.LOWER}')"
    rules = [
        ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
        ("net/es/", "block"), ("net/fr/", "block"),
    ]
    listed = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules)
    link = H.LINK.replace("'", "''")
    steps = "".join(
        f""",
    flow_{i} AS (
        SELECT kind, dst AS host, (r.rank::HUGEINT * weight // total)::BIGINT AS rank
        FROM rank_{i - 1} r JOIN both_ways USING (kind, src)),
    rank_{i} AS (
        SELECT kind, host AS src, ((100 - {H.DAMPING}) * sum(seed) + {H.DAMPING} * sum(rank)) // 100 AS rank
        FROM (SELECT kind, host, 0 AS seed, rank FROM flow_{i}
              UNION ALL SELECT kind, src, rank, 0 FROM rank_0) GROUP BY kind, host)"""
        for i in range(1, H.ROUNDS + 1)
    )
    return rf"""
    WITH RECURSIVE rules(rule, h, p, v) AS (VALUES {listed}),
    placed AS (
        SELECT row_number() OVER () AS r, page_id, html, {small % f"regexp_extract(coalesce(url, ''), '{H.URL}', 1)"} AS host,
               regexp_extract(coalesce(url, ''), '{H.URL}', 2) AS path FROM pages),
    best AS (
        SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS listed
        FROM placed JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p) GROUP BY r),
    ruled AS (SELECT * FROM placed LEFT JOIN best USING (r)),
    seeds AS (
        SELECT host, count(*) FILTER (listed = 'allow') AS trusted, count(*) FILTER (listed = 'block') AS blocked
        FROM ruled WHERE host <> '' GROUP BY host),
    links AS (
        SELECT host AS src, {small % "x"} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS x FROM placed)),
    domains(d) AS (
        SELECT host FROM seeds
        UNION SELECT d[instr(d, '.') + 1:] FROM domains WHERE instr(d[instr(d, '.') + 1:], '.') > 0 AND instr(d, '.') > 0),
    upward AS (
        SELECT d AS src, d[instr(d, '.') + 1:] AS dst FROM domains WHERE instr(d, '.') > 0 AND instr(d[instr(d, '.') + 1:], '.') > 0),
    edges AS (
        SELECT src, dst, count(*) AS weight
        FROM (SELECT src, dst FROM links WHERE src <> '' AND src <> dst
              UNION ALL SELECT src, dst FROM upward UNION ALL SELECT dst, src FROM upward) GROUP BY src, dst),
    ways AS (
        SELECT 'trust' AS kind, src, dst, weight FROM edges UNION ALL SELECT 'distrust', dst, src, weight FROM edges),
    both_ways AS (SELECT *, sum(weight) OVER (PARTITION BY kind, src) AS total FROM ways),
    starts AS (
        SELECT 'trust' AS kind, host AS src, trusted AS mass FROM seeds WHERE trusted > 0
        UNION ALL SELECT 'distrust', host, blocked FROM seeds WHERE blocked > 0),
    rank_0 AS (
        SELECT kind, src, (mass::HUGEINT * {H.SCALE} // sum(mass) OVER (PARTITION BY kind))::BIGINT AS rank FROM starts)
    {steps},
    scores AS (
        SELECT src AS host, sum(rank) FILTER (kind = 'trust') AS trust, sum(rank) FILTER (kind = 'distrust') AS distrust
        FROM rank_{H.ROUNDS} GROUP BY src),
    whole AS (SELECT host, coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust FROM scores)
    SELECT page_id, host, path, rule, coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust,
           coalesce(listed, CASE WHEN distrust > trust AND 
               distrust * (SELECT count(*) FROM seeds) >= {H.BLOCK_FACTOR} * (SELECT sum(distrust) FROM whole) THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled LEFT JOIN whole USING (host)"""


def license_scan() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    split = f"regexp_extract_all(translate(%s, '{H.UPPER}', '{H.LOWER}'), '{word}')"
    templates = ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text) in enumerate(L.TEMPLATES))
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in L.PHRASES.items())
    size = "len(ws)"

    def grams(n: str) -> str:
        """Places from 0 and the n words from there."""
        return f"""unnest(range(0, {size} - {n} + 1)) AS place,
               unnest(list_transform(range(0, {size} - {n} + 1), lambda i: array_to_string(ws[i + 1:i + {n}], ' '))) AS g"""

    last = L.GRAM - 1
    return f"""
    WITH templates AS (
        SELECT t, label, {split % "txt"} AS ws FROM (VALUES {templates}) v(t, label, txt)),
    phrases(p, label, n) AS (VALUES {phrases}),
    texts AS (SELECT row_number() OVER () AS r, doc_id, {split % "coalesce(text, '')"} AS ws FROM documents),
    base_places AS (
        SELECT r, place, label
        FROM (SELECT r, n, label, p, {grams("n")} FROM texts, phrases WHERE len(ws) >= n) WHERE g = p),
    base AS (
        SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS found
        FROM base_places GROUP BY r),
    votes AS (
        SELECT DISTINCT r, t, a.place AS start, b.place
        FROM (SELECT r, {grams(str(L.GRAM))} FROM texts WHERE len(ws) >= {L.GRAM}) a
        JOIN (SELECT t, {grams(str(L.GRAM))} FROM templates) b USING (g)),
    lines AS (
        SELECT r, t, start - place AS diagonal, min(start) AS first, max(start) AS last, list(DISTINCT place) AS places
        FROM votes GROUP BY r, t, start - place),
    marked AS (
        SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER w) <= {L.DRIFT} AND first <= lag(last) OVER w + {L.GRAM + L.DRIFT}
                       THEN 0 ELSE 1 END AS fresh
        FROM lines WINDOW w AS (PARTITION BY r, t ORDER BY first, diagonal)),
    numbered AS (
        SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY first, diagonal ROWS UNBOUNDED PRECEDING) AS stretch FROM marked),
    merged AS (
        SELECT r, t, min(first) AS first, max(last) + {L.GRAM} AS last,
               len(list_distinct(flatten(list_transform(flatten(list(places)), lambda p: range(p, p + {last} + 1))))) AS covered
        FROM numbered GROUP BY r, t, stretch),
    spans AS (
        SELECT r, label, covered / len(ws) AS coverage,
               100 * covered >= {L.COVERAGE} * len(ws)
               AND 100 * (last - first) <= {200 - L.COVERAGE} * len(ws) + {100 * L.DRIFT} AS verified
        FROM merged JOIN templates USING (t)),
    voted AS (SELECT r, list(DISTINCT label) FILTER (verified) AS labels, max(coverage) AS coverage FROM spans GROUP BY r)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
           array_to_string(coalesce(found, []), ',') AS base_labels,
           array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(labels, [])))), ',') AS labels,
           CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(coverage, 0.0) END::DOUBLE AS score
    FROM texts LEFT JOIN base USING (r) LEFT JOIN voted USING (r)"""


def largest_products(k: int = 5) -> str:
    return f"""
    WITH vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
        FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= {k}"""


def poisson_mix() -> str:
    return rf"""
    WITH RECURSIVE sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source),
    rates AS (
        SELECT source, CASE WHEN chars > 0 THEN (SELECT sum(chars) FROM sizes) * pow(chars, {P.TEMPERATURE})
               / (SELECT sum(pow(chars, {P.TEMPERATURE})) FROM sizes) / chars ELSE 0 END::DOUBLE AS rate FROM sizes),
    parted AS (SELECT *, greatest(1, ceil(rate / {P.PART_RATE}))::INTEGER AS parts FROM rates),
    terms(source, parts, part, k, p, s) AS (
        SELECT source, parts, rate / parts, 0, exp(-rate / parts), exp(-rate / parts) FROM parted
        UNION ALL SELECT source, parts, part, k + 1, p * part / (k + 1), s + p * part / (k + 1) FROM terms WHERE k < {P.TERMS}),
    sums AS (SELECT source, parts, list(s) AS sums FROM terms GROUP BY source, parts),
    drawn AS (
        SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(sums, lambda s: s <=
                   ('0x' || substr(md5(concat_ws('|', '{P.SEED}', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')), j)), 1, 12))::BIGINT
                   / {float(1 << 48)!r})))) AS copies
        FROM documents d JOIN sums ON d.source IS NOT DISTINCT FROM sums.source)
    SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies::BIGINT + 1))::INTEGER AS copy FROM drawn"""


def near_duplicates(n: int = 3, percent: int = 90) -> str:
    return rf"""
    WITH RECURSIVE texts AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^ 	-
]+') AS ws
        FROM documents),
    sets AS (
        SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
               ELSE list_distinct(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) END AS grams
        FROM texts),
    classes AS (
        SELECT min(r) AS c, list_sort(grams) AS g, len(any_value(grams)) AS n, min(doc_id) AS least
        FROM sets WHERE len(grams) > 0 GROUP BY list_sort(grams)),
    elements AS (SELECT c, n, unnest(g) AS e FROM classes),
    pairs AS (
        SELECT a.c AS a, b.c AS b FROM elements a JOIN elements b ON a.e = b.e AND a.c < b.c
        GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
    edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (SELECT c AS x, c AS y FROM classes UNION SELECT x, b FROM reach JOIN edges ON y = a),
    named AS (SELECT x AS c, min(least) AS component_id FROM reach JOIN classes ON y = c GROUP BY x)
    SELECT doc_id, len(grams)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
    FROM sets LEFT JOIN classes ON g = list_sort(grams) LEFT JOIN named USING (c)"""


def repeats_removed(window: int = 35) -> str:
    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws, len({WORDS}) AS n_words FROM documents),
    windows AS (
        SELECT r, unnest(range(1, n_words - {window} + 2)) AS i,
               unnest(list_transform(range(1, n_words - {window} + 2),
                      lambda x: md5(array_to_string(ws[x:x + {window - 1}], ' ')))) AS g
        FROM texts WHERE n_words >= {window}),
    twice AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS j FROM windows SEMI JOIN twice USING (g)),
    kept AS (
        SELECT r, string_agg(w, ' ' ORDER BY j) AS text, count(*) AS n
        FROM (SELECT r, unnest(range(1, n_words + 1)) AS j, unnest(ws) AS w FROM texts) ANTI JOIN gone USING (r, j)
        GROUP BY r)
    SELECT doc_id, n_words, (n_words - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (r)"""


def decontamination() -> str:
    split = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{D.UPPER}', '{D.LOWER}'), '{D.BETWEEN}+'), lambda x: x <> '')"

    def grams(n: str) -> str:
        return f"unnest(list_transform(range(1, len(ws) - {n} + 2), lambda i: array_to_string(ws[i:i + {n} - 1], ' '))) AS g"

    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {split} AS ws FROM documents),
    items AS (SELECT item_id, ws, least(len(ws), {D.WINDOW}) AS n FROM (SELECT item_id, {split} AS ws FROM benchmark) WHERE len(ws) > 0),
    grams AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, {grams("n")} FROM items)),
    places AS (
        SELECT r, n, unnest(range(1, len(ws) - n + 2)) AS i, {grams("n")}
        FROM texts, (SELECT DISTINCT n FROM items) WHERE len(ws) >= n),
    found AS (SELECT * FROM places WHERE g IN (SELECT g FROM grams)),
    hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM found) GROUP BY r),
    listed AS (
        SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids
        FROM (SELECT DISTINCT r, g FROM found) JOIN grams USING (g) WHERE item_id IS NOT NULL GROUP BY r)
    SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
           sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM texts LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)"""


def ranked_search() -> str:
    split = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{Q.UPPER}', '{Q.LOWER}'), '{Q.TERM_BREAK}'), lambda x: x <> '')"
    return rf"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {split} AS ws FROM documents),
    items AS (SELECT row_number() OVER () AS q, item_id, {split} AS ws FROM benchmark),
    total AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS terms FROM texts WHERE len(ws) > 0),
    asked AS (SELECT DISTINCT q, item_id, unnest(ws) AS t FROM items),
    held AS (
        SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS t FROM texts)
        WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
    weights AS (
        SELECT t, floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held GROUP BY t),
    scores AS (
        SELECT q, item_id, r, doc_id,
               sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
        FROM asked JOIN weights USING (t) JOIN held USING (t), total GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {Q.BEST}"""


def manifest() -> str:
    def field(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR END"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(field(text if name == 'text' else name) for name in M.FIELDS)})"

    # CRC-32 bit by bit: each byte is added, then eight shifts.
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT)"""

    def tree(name: str, first: str) -> str:
        """(g, level, pos, digest) from the nodes of the lowest level."""
        return f"""
    {name}(g, level, pos, digest, n) AS (
        SELECT g, 0, pos, digest, n FROM ({first})
        UNION ALL
        SELECT g, any_value(level) + 1, pos // {M.FAN}, sha256(string_agg(digest, '' ORDER BY pos)), any_value(n + {M.FAN} - 1) // {M.FAN}
        FROM {name} WHERE n > 1 GROUP BY g, pos // {M.FAN})"""

    def fold(name: str, nodes: str, first: str) -> str:
        """(r, level, pos, proof, acc) step by step along the siblings."""
        return f"""
    {name}(r, g, level, pos, n, proof, acc) AS (
        {first}
        UNION ALL
        SELECT f.r, any_value(f.g), any_value(f.level) + 1, any_value(f.pos) // {M.FAN}, any_value(f.n + {M.FAN} - 1) // {M.FAN},
               any_value(f.proof) || coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos <> f.pos), ''),
               sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.acc ELSE t.digest END, '' ORDER BY t.pos))
        FROM {name} f JOIN {nodes} t ON t.g = f.g AND t.level = f.level AND t.pos // {M.FAN} = f.pos // {M.FAN}
        WHERE f.n > 1 GROUP BY f.r)"""

    return f"""
    WITH RECURSIVE leaves AS (
        SELECT row_number() OVER () AS r, doc_id, source, {leaf("text")} AS leaf,
               CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS altered
        FROM documents),
    sources AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
    placed AS (
        SELECT l.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
        FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source),
    {tree("nodes", "SELECT g, pos, leaf AS digest, n FROM placed")},
    subroots AS (SELECT g, digest AS subroot FROM nodes WHERE n = 1),
    {tree("tops", "SELECT 0 AS g, g AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots")},
    {fold("lower", "nodes", "SELECT r, g, 0, pos, n, '', altered FROM placed")},
    {fold("upper", "tops", "SELECT r, 0, 0, g, (SELECT count(*) FROM subroots), proof, acc FROM lower WHERE n = 1")}
    SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(proof) AS proof_sha256,
           acc AS folded_root, acc = (SELECT digest FROM tops WHERE n = 1) AS verified
    FROM placed JOIN subroots USING (g) JOIN upper u USING (r) WHERE u.n = 1"""


ORACLES: dict[str, str] = {
    "op1_host_trust": host_trust(),
    "op3_repetition_rules": repetition_rules(),
    "op5_partenum_join": near_duplicates(),
    "op6_license_scan": license_scan(),
    "op7_pivot_search": largest_products(),
    "op8_poisson_mix": poisson_mix(),
    "op9_recompression": repeats_removed(),
    "op11_pipelined_search": ranked_search(),
    "op12_decontamination": decontamination(),
    "op13_merkle_manifest": manifest(),
}
