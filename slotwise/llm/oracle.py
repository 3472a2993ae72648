"""DuckDB SQL with the same rows as the queries, where SQL can express them."""

OP2 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (
  SELECT payload_digest, payload_bytes, max(page_id) AS response FROM p
  WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response <> page_id THEN response END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN k USING (payload_digest, payload_bytes)
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(len(w), 13) AS m,
    unnest([array_to_string(w[i:i + least(len(w), 13) - 1], ' ')
      FOR i IN range(1, greatest(len(w) - 12, 1) + 1)]) AS win
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS s, w FROM d, sizes WHERE len(w) >= m),
hits AS (
  SELECT DISTINCT x.doc_id, x.s, x.m, bw.item_id FROM
    (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win FROM dw) x
    JOIN bw ON bw.m = x.m AND bw.win = x.win),
words AS (SELECT DISTINCT doc_id, unnest(range(s, s + m)) AS p FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY 1),
i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words,
  coalesce(n.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP10 = r"""
WITH p AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS piece
  FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
held AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS nr
  FROM p WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT doc_id, nr, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c
  FROM held WINDOW o AS (PARTITION BY doc_id ORDER BY nr)),
later AS (
  SELECT doc_id, nr FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, nr) AS nth
    FROM w WHERE c IS NOT NULL) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest([nr, nr + 1, nr + 2]) AS nr FROM later),
left_over AS (
  SELECT p.doc_id, p.piece, p.line FROM p LEFT JOIN held USING (doc_id, piece)
  LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.nr = held.nr WHERE gone.nr IS NULL),
t AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY piece) AS text FROM left_over GROUP BY 1)
SELECT d.doc_id,
  CASE WHEN d.text IS NULL THEN NULL
    ELSE CAST(strlen(coalesce(t.text, '')) AS BIGINT) END AS n_bytes,
  sha256(coalesce(t.text, CASE WHEN d.doc_id IS NULL THEN d.text END, '')) AS kept_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""


def raking_sql(rounds: int = 12) -> str:
    """One common table for each scaling step, as many as the query makes."""
    steps, last = [], "r0"
    dims = ("source", "lang", "topic")
    for i in range(rounds * len(dims)):
        dim, name = dims[i % len(dims)], f"r{i + 1}"
        steps.append(
            f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, w * t_{dim} / "
            f"sum(w) OVER (PARTITION BY {dim}) AS w FROM {last})"
        )
        last = name
    goals = ",\n".join(
        f"g_{d} AS (SELECT {d}, s / sum(s) OVER () AS t_{d} FROM (SELECT {d}, "
        f"pow(CAST(sum(tokens) AS DOUBLE), 0.5) AS s FROM cells WHERE tokens > 0 GROUP BY 1))"
        for d in dims
    )
    joins = " ".join(
        f"JOIN g_{d} ON cells.{d} IS NOT DISTINCT FROM g_{d}.{d}" for d in dims
    )
    return f"""
WITH d AS (
  SELECT doc_id, source, lang, CASE WHEN text IS NULL OR text = '' THEN 'empty'
      WHEN contains(text, ' | ') THEN 'table'
      WHEN contains(text, '###') OR contains(text, '***') THEN 'symbols'
      WHEN strlen(text) < 400 THEN 'short' ELSE 'prose' END AS topic,
    CAST(coalesce(ceil(strlen(text) / 4), 0) AS BIGINT) AS tokens FROM documents),
cells AS (
  SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
{goals},
r0 AS MATERIALIZED (
  SELECT cells.source, cells.lang, cells.topic, tokens, t_source, t_lang, t_topic,
    CAST(tokens AS DOUBLE) AS w FROM cells {joins} WHERE tokens > 0),
{", ".join(steps)},
rates AS (
  SELECT source, lang, topic,
    w * CAST(sum(tokens) OVER () AS DOUBLE) * 0.5 / (sum(w) OVER () * tokens) AS rate FROM {last}),
p AS (
  SELECT d.*, round(least(coalesce(rate, 0), 1), 9) AS probability,
    round(greatest(coalesce(rate, 0), 1), 6) AS weight
  FROM d LEFT JOIN rates ON d.source IS NOT DISTINCT FROM rates.source
    AND d.lang IS NOT DISTINCT FROM rates.lang AND d.topic IS NOT DISTINCT FROM rates.topic)
SELECT *, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '-mix'), 1, 13) AS BIGINT)
  / 4503599627370496.0 < probability AS sampled FROM p
"""


OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest([md5_number(array_to_string(w[i:i + least(len(w), 4) - 1], ' '))
    FOR i IN range(1, greatest(len(w) - 3, 1) + 1)]) AS shingle
  FROM d WHERE len(w) > 0),
n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n, bit_xor(shingle) AS whole FROM s GROUP BY 1),
one AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n, whole) AS least, n FROM n),
o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM (SELECT s.* FROM s JOIN one USING (doc_id) WHERE doc_id = least) x
  JOIN (SELECT s.* FROM s JOIN one USING (doc_id) WHERE doc_id = least) y
    ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * shared >= 80 * (p.n + q.n - shared)
  UNION ALL SELECT least, doc_id FROM one WHERE doc_id <> least),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT DISTINCT a AS node, a AS found FROM both_ways
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.found),
c AS (SELECT node, min(found) AS component FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
  coalesce(d.doc_id = coalesce(c.component, d.doc_id), true) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
""".replace("WITH d AS", "WITH RECURSIVE d AS", 1)


def _encoded(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"


def _tree_sql(name: str, start: str, levels: int) -> str:
    """Nodes and their siblings of every level of a tree, a common table for each."""
    out = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        out.append(
            f"{name}_s{k} AS MATERIALIZED (SELECT a.tree, a.i, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS before, "
            f"coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS after "
            f"FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 3 = b.i // 3 "
            f"WHERE a.n > 1 GROUP BY 1, 2)"
        )
        out.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 3 AS i, (any_value(n) + 2) // 3 AS n, "
            f"CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h "
            f"FROM {name}{k} GROUP BY 1, i // 3)"
        )
    return ",\n".join(out)


def manifest_sql(leaf_levels: int = 16, source_levels: int = 10) -> str:
    """Enough levels for 43 million rows of a source and 59 thousand sources."""
    head = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
        " lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),"
        " lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"
    )
    folds, last, proof = [], "other", []
    steps = [("l", k, f"nr // {3**k}") for k in range(leaf_levels)]
    steps += [("r", k, f"snr // {3**k}") for k in range(source_levels)]
    for j, (name, k, at) in enumerate(steps):
        tree = "p.tree" if name == "l" else "''"
        folds.append(
            f"f{j} AS MATERIALIZED (SELECT p.* EXCLUDE (fold, proof), CASE WHEN s.i IS NULL THEN fold "
            f"ELSE sha256(before || fold || after) END AS fold, "
            f"proof || coalesce(before || after, '') AS proof FROM {f'f{j - 1}' if j else 'start'} p "
            f"LEFT JOIN {name}_s{k} s ON s.tree = {tree} AND s.i = {at})"
        )
    return f"""
WITH leaves AS MATERIALIZED (
  SELECT doc_id, source, {_encoded("source")} AS tree, sha256({head} || {_encoded("text")}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 2 = 0
      THEN sha256({head} || {_encoded("replace(text, chr(10), '')")})
      ELSE sha256({head} || {_encoded("text")}) END AS other
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS nr,
    count(*) OVER (PARTITION BY tree) AS n,
    dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS snr FROM leaves),
{_tree_sql("l", "SELECT tree, nr AS i, n, leaf AS h FROM placed", leaf_levels)},
tops AS MATERIALIZED (
  SELECT t.tree, t.h, min(snr) AS snr FROM l{leaf_levels} t JOIN placed p ON p.tree = t.tree GROUP BY ALL),
{_tree_sql("r", "SELECT '' AS tree, snr AS i, count(*) OVER () AS n, h FROM tops", source_levels)},
start AS (SELECT *, {last} AS fold, '' AS proof FROM placed),
{", ".join(folds)}
SELECT doc_id, leaf, tops.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256,
  fold AS folded_root, fold = top.h AS verified
FROM f{len(steps) - 1} p JOIN tops USING (tree) CROSS JOIN r{source_levels} top
"""


OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, doc, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT lang, row_number() OVER () AS doc, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k)
    WHERE len(w) >= k)),
f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 10),
parts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS q, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, x.a AS l, y.a AS r,
    CAST(1000000 * c.a::HUGEINT * c.a // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM parts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(q[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(q[cut + 1:], ' ')),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, part, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
      array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part FROM f WHERE k = 3) GROUP BY ALL),
left_over AS (
  SELECT x.* FROM lowest x LEFT JOIN inside i ON k = 2 AND i.lang = x.lang AND i.part = phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM left_over) JOIN n USING (lang) WHERE rank <= 2000
"""


SQL: dict[str, str] = {
    "op2_zstandard_archives": OP2,
    "op6_raked_mix": raking_sql(),
    "op9_winnowed_contamination": OP9,
    "op10_winnowed_lines": OP10,
    "op11_bottom_sketches": OP11,
    "op12_nested_manifest": manifest_sql(),
    "op13_tiled_phrases": OP13,
}
