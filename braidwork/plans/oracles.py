"""DuckDB twins of the registered queries, over the same fixtures."""

from __future__ import annotations

from braidwork.functions.text import PROMPT_HEAD, PROMPT_TAIL
from braidwork.plans import fixtures as X
from braidwork.plans import queries as Q

# Stated again, so that a wrong constant of the engine shows. The prompt is one text and is not.
SPACE = r"\t-\r\x1c-\x20\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DELETED = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xff]"
ENDINGS = (r"inc\.?", r"corp\.?", r"ltd\.?", "llc", r"co\.?")
TYPES = "PERSON, ORGANIZATION, LOCATION, EVENT, CONCEPT, TECHNOLOGY, PRODUCT, DATE"


def _sub(x: str, pattern: str, to: str = "", flags: str = ", 'g'") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}'{flags})"


def _strip(x: str) -> str:
    return _sub(x, f"^[{SPACE}]+|[{SPACE}]+$")


def _collapse(x: str) -> str:
    return _sub(x, f"[{SPACE}]+", " ")


def _clean(x: str) -> str:
    return _strip(_sub(_collapse(f"coalesce({x}, '')"), DELETED))


def _norm(x: str) -> str:
    out = _strip(f"lower({x})")
    for ending in ENDINGS:
        out = _sub(out, f"[{SPACE}]+{ending}$", flags="")
    return _strip(_collapse(_sub(out, rf"[^\p{{L}}\p{{N}}_{SPACE}.]")))


def _entity_norm(x: str) -> str:
    return _sub(_collapse(_strip(f"lower({x})")), "^(the )?(a )?(an )?", flags="")


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_collapse(_strip(x))}, ' '), lambda w: w <> ''))"


def _similarity(a: str, b: str) -> str:
    wa, wb = _words(a), _words(b)
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.9::DOUBLE ELSE coalesce(len(list_intersect({wa}, {wb}))::DOUBLE / nullif(len(list_distinct(list_concat({wa}, {wb}))), 0), 0) END"


def _cosine(a: str, b: str) -> str:
    return f"coalesce(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 0)"


def _short(x: str, width: int) -> str:
    """Words up to a width, with a mark if any are left out; for texts without hyphens, at which wrapping may break."""
    text = _collapse(_strip(f"coalesce({x}, '')"))
    words = f"string_split({text}, ' ')[1:{width}]"
    return f"CASE WHEN length({text}) <= {width} THEN {text} ELSE concat(coalesce(list_last(list_filter(list_transform(range(1, len({words}) + 1), lambda k: array_to_string({words}[1:k], ' ')), lambda t: length(t) < {width})), ''), '…') END"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_lit(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + f") t({names})"


def _ratio(query: str, c: str) -> str:
    terms = "[" + ", ".join(_lit(w) for w in dict.fromkeys(query.lower().split())) + "]"
    return f"len(list_intersect({terms}, {_words(f'lower({c})')}))::DOUBLE / len({terms})"


def all_oracles() -> dict[str, str]:
    docs, me, mr, ge, gr, ve, vr, vc, rs = map(X.duck, (X.DOCS, X.MERGE_ENTITIES, X.MERGE_RELS, X.GRAPH_ENTITIES, X.GRAPH_RELS, X.VEC_ENTITIES, X.VEC_RELS, X.VEC_CHUNKS, X.RESPONSES))
    out: dict[str, str] = {}
    vec0 = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"

    # text
    out["clean_text"] = f"SELECT id, {_clean('content')} AS cleaned FROM ({docs})"
    out["token_estimate"] = f"SELECT id, length(content) // 4 AS tokens FROM ({docs})"
    head = PROMPT_HEAD.replace("{types}", TYPES).replace("{most}", "20")
    out["extraction_prompt"] = f"SELECT id, concat({_lit(head)}, content, {_lit(PROMPT_TAIL)}) AS prompt FROM ({docs})"
    out["normalize_name"] = f"SELECT ord, {_norm('''concat(' ', name, '!, Co.')''')} AS a, {_norm('name')} AS b FROM ({me})"
    out["normalize_entity_name"] = f"SELECT ord, {_entity_norm('''concat(' The  ', source_entity)''')} AS a, {_entity_norm('source_entity')} AS b FROM ({mr})"
    out["name_similarity"] = f"WITH n AS (SELECT ord, {_norm('name')} AS norm FROM ({me})) SELECT n.ord, round({_similarity('n.norm', 'o.norm')}, 6) AS similarity FROM n JOIN n o ON o.ord = n.ord + 1"
    out["chunk_documents"] = f"""
WITH RECURSIVE d AS (SELECT id, content, length(content) AS n FROM ({docs}) WHERE {_strip('content')} <> ''),
c(id, s, e) AS (
  SELECT id, 0, CASE WHEN 800 < n AND length(regexp_extract(substring(content, 1, 800), '(?s)^.*[.\\n]')) > 1 THEN length(regexp_extract(substring(content, 1, 800), '(?s)^.*[.\\n]')) ELSE 800 END FROM d
  UNION ALL
  SELECT id, s2, CASE WHEN s2 + 800 < n AND length(regexp_extract(substring(content, s2 + 1, 800), '(?s)^.*[.\\n]')) > 1 THEN s2 + length(regexp_extract(substring(content, s2 + 1, 800), '(?s)^.*[.\\n]')) ELSE s2 + 800 END
  FROM (SELECT c.id, d.content, d.n, CASE WHEN c.e - 150 > greatest(0, c.s) THEN c.e - 150 ELSE c.e END AS s2 FROM c JOIN d ON c.id = d.id) WHERE s2 < n),
t AS (SELECT c.id, s, e, {_strip('substring(content, s + 1, e - s)')} AS text FROM c JOIN d ON c.id = d.id)
SELECT concat(id, '_chunk_', k) AS id, k::INTEGER AS chunk_index, s::INTEGER AS start, e::INTEGER AS "end", text
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS k FROM t WHERE text <> '')"""

    # extraction
    parts = f"""
WITH r AS (SELECT chunk_id, ord, unnest(l) AS rec, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT chunk_id, ord, string_split(response, '##') AS l FROM ({rs}))),
s AS (SELECT chunk_id, ord, pos, {_strip('rec')} AS rec FROM r),
p AS (SELECT chunk_id, ord, pos, list_transform(string_split(CASE WHEN length(rec) < 2 THEN '' ELSE substring(rec, 2, length(rec) - 2) END, '<|>'), lambda x: {_strip('x')}) AS f FROM s WHERE rec <> '<|COMPLETE|>' AND rec[1] = '(' AND rec[-1] = ')')"""
    many = parts.replace(f"({rs})", f"({X.duck(X.MANY_RESPONSES)})")
    out["parse_entities"] = many + " SELECT ord, pos::INTEGER AS pos, f[1] AS name, upper(f[2]) AS type, f[3] AS description, chunk_id AS chunks, 1.0::DOUBLE AS confidence FROM p WHERE len(f) = 3 AND f[1] <> '' AND f[2] <> ''"
    out["parse_relationships"] = many + " SELECT ord, pos::INTEGER AS pos, f[1] AS source_entity, f[3] AS target_entity, upper(f[2]) AS relationship_type, f[4] AS description, chunk_id AS chunks FROM p WHERE len(f) = 4 AND f[1] <> '' AND f[2] <> '' AND f[3] <> ''"

    # resolution
    node = f"e AS ({me}), k AS (SELECT *, upper(type) AS block, {_norm('name')} AS norm FROM e), n AS (SELECT block, norm, min(ord) AS ord FROM k GROUP BY ALL)"
    pair = f"p AS (SELECT a.block, a.ord AS a, b.ord AS b, {_similarity('a.norm', 'b.norm')} AS sim FROM n a JOIN n b ON a.block = b.block AND a.ord < b.ord)"
    out["name_similarity_join"] = f"WITH {node}, {pair} SELECT a, b, round(sim, 6) AS similarity FROM p WHERE sim >= 0.6"
    total = f"0.7 * ({_similarity('a.norm', 'b.norm')}) + 0.3 * {_cosine('a.embedding', 'b.embedding')}"
    vec_pair = f"e AS (SELECT *, {_norm('name')} AS norm FROM ({ve})), p AS (SELECT a.type AS block, a.ord AS a, b.ord AS b, {total} AS sim FROM e a JOIN e b ON a.type = b.type AND a.ord < b.ord)"
    out["entity_pair_similarity"] = f"WITH {vec_pair} SELECT a, b, round(sim, 6) AS similarity FROM p WHERE sim >= 0.6"
    greedy = f"""WITH RECURSIVE {node}, {pair},
near AS (SELECT b AS ord, list(a) AS l FROM p WHERE sim >= 0.8 GROUP BY b),
o AS (SELECT n.block, n.ord, coalesce(l, []) AS l, row_number() OVER (PARTITION BY n.block ORDER BY n.ord) AS i FROM n LEFT JOIN near USING (ord)),
g(block, i, leads) AS (
  SELECT block, 1::BIGINT, [ord] FROM o WHERE i = 1
  UNION ALL SELECT g.block, o.i, CASE WHEN list_has_any(o.l, g.leads) THEN g.leads ELSE list_append(g.leads, o.ord) END FROM g JOIN o ON o.block = g.block AND o.i = g.i + 1),
f AS (SELECT block, arg_max(leads, i) AS leads FROM g GROUP BY block),
lead AS (SELECT o.block, o.ord, CASE WHEN list_contains(leads, o.ord) THEN o.ord ELSE list_min(list_intersect(o.l, leads)) END AS leader FROM o JOIN f USING (block)),
c AS (SELECT k.*, lead.leader FROM k JOIN n ON k.block = n.block AND k.norm = n.norm JOIN lead ON lead.ord = n.ord)"""
    out["greedy_clusters"] = greedy + " SELECT ord, leader FROM c"
    out["greedy_clusters_embedding"] = f"WITH RECURSIVE {vec_pair}, n AS (SELECT type AS block, ord FROM e)," + greedy[greedy.index("\nnear AS") : greedy.index(",\nc AS")].replace("sim >= 0.8", "sim >= 0.6") + " SELECT ord, leader FROM lead"
    first_list = f"array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(list({_strip('description')} ORDER BY ord), lambda x: x <> ''), lambda x: [x])), lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN acc ELSE list_concat(acc, x) END), ' | ')"
    out["merge_entities"] = greedy + f""" SELECT leader AS ord, arg_min(name, (-length({_strip('name')}), ord)) AS name, arg_min(type, ord) AS type,
CASE WHEN count(*) = 1 THEN min(description) ELSE {first_list} END AS description, string_agg(DISTINCT chunk, ',' ORDER BY chunk) AS chunks, round(avg(confidence), 6) AS confidence FROM c GROUP BY leader"""
    out["merge_relationships"] = f"""SELECT min(ord) AS ord, arg_min(source_entity, ord) AS source_entity, arg_min(target_entity, ord) AS target_entity, relationship_type,
CASE WHEN count(*) = 1 THEN min(description) ELSE string_agg(DISTINCT description, '; ' ORDER BY description) END AS description, string_agg(DISTINCT chunk, ',' ORDER BY chunk) AS chunks, round(avg(confidence), 6) AS confidence
FROM ({mr}) GROUP BY {_entity_norm('source_entity')}, {_entity_norm('target_entity')}, relationship_type"""

    # vectors
    scored = f"SELECT *, round({_cosine('embedding', vec0)}, 6) AS similarity FROM ({{}})"
    ents, chunks = scored.format(ve), scored.format(vc)
    out["cosine_similarity"] = f"SELECT name, similarity FROM ({ents})"
    out["clamped_cosine"] = f"SELECT name, greatest(0, similarity) AS similarity FROM ({ents})"
    out["entity_embedding_text"] = f"SELECT ord, concat(name, ': ', CASE WHEN ord % 5 > 0 THEN description ELSE '' END) AS text FROM ({ve})"
    out["search_entities"] = f"SELECT name, similarity FROM ({ents}) WHERE similarity >= 0 ORDER BY similarity DESC, ord LIMIT 10"
    out["similar_entities"] = f"SELECT name, similarity FROM ({ents}) WHERE name <> 'vec_0' ORDER BY similarity DESC, ord LIMIT 5"
    out["search_chunks"] = f"SELECT id, similarity FROM ({chunks}) ORDER BY similarity DESC, ord LIMIT 5"
    out["search_fallback"] = f"""WITH e AS ({ents}), h AS (SELECT * FROM e WHERE similarity >= 0.3 ORDER BY similarity DESC, ord LIMIT 10),
c AS (SELECT lower(text) AS body FROM ({chunks}) ORDER BY similarity DESC, ord LIMIT 5),
m AS (SELECT name FROM e WHERE name NOT IN (SELECT name FROM h) AND EXISTS (SELECT 1 FROM c WHERE contains(body, lower(e.name))) ORDER BY ord)
SELECT name, similarity, 'entity' AS source FROM h UNION ALL SELECT * FROM (SELECT name, 0.5::DOUBLE, 'text' FROM m LIMIT CASE WHEN (SELECT count(*) FROM h) < 5 THEN (SELECT 10 - count(*) FROM h) ELSE 0 END)"""
    block = "concat('Entity: ', name, chr(10), 'Type: ', type, chr(10), 'Description: ', description, chr(10))"
    out["entity_context"] = f"SELECT string_agg(b, chr(10) ORDER BY ord) AS context FROM (SELECT ord, {block} AS b, sum(length({block})) OVER (ORDER BY ord) AS total FROM ({ve})) WHERE total <= 500"

    # graph
    adj = f"r AS ({gr}), adj AS (SELECT source_entity AS src, target_entity AS dst, relationship_type, confidence, ord AS rel_ord, 0 AS dir FROM r UNION ALL SELECT target_entity, source_entity, relationship_type, confidence, ord, 1 FROM r), e AS ({ge})"
    ranked = adj + ", nb AS (SELECT adj.*, e.type, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, rel_ord, dir) AS rank FROM adj JOIN e ON e.name = dst)"
    out["adjacency"] = f"WITH {adj} SELECT src, dst, relationship_type, rel_ord, dir FROM adj"
    out["find_neighbors"] = f"WITH {ranked} SELECT src, dst, rel_ord, dir, rank::INTEGER AS rank FROM nb WHERE rank <= 10"
    out["simple_paths"] = f"""WITH RECURSIVE {adj}, w(path, tip) AS (SELECT ['NATION_1'], 'NATION_1' UNION ALL
SELECT list_append(path, dst), dst FROM w JOIN adj ON src = tip WHERE tip <> 'NATION_6' AND NOT list_contains(path, dst) AND len(path) < 4) SELECT array_to_string(path, '>') AS path FROM w WHERE tip = 'NATION_6'"""
    central = _values([(n, i) for i, n in enumerate(Q.CENTRAL)], "name, ord")
    out["degree_centrality"] = f"WITH {adj} SELECT t.name, s.n AS score, t.ord::BIGINT AS ord FROM {central} JOIN (SELECT src, count(*) AS n FROM adj GROUP BY src) s ON s.src = t.name WHERE t.name IN (SELECT name FROM e)"
    small = _values([(n, i) for i, n in enumerate(Q.SMALL)], "name, ord")
    out["betweenness_approx"] = f"""WITH {adj}, s AS (SELECT * FROM {small} WHERE name IN (SELECT name FROM e)),
q AS (SELECT a.name AS a, b.name AS b, a.ord * 10 + b.ord AS pair FROM s a JOIN s b ON a.ord < b.ord AND a.name <> b.name WHERE NOT EXISTS (SELECT 1 FROM adj WHERE src = a.name AND dst = b.name)),
m AS (SELECT pair, arg_min(x.dst, (x.rel_ord, x.dir)) AS name FROM q JOIN adj x ON x.src = a AND x.dst <> a AND x.dst <> b WHERE EXISTS (SELECT 1 FROM adj y WHERE y.src = b AND y.dst = x.dst) GROUP BY pair)
SELECT name, count(*)::DOUBLE AS score FROM m WHERE name IN (SELECT name FROM e) GROUP BY name"""
    expand = "SELECT 0 AS ord, name FROM e WHERE name = '{0}' UNION ALL SELECT * FROM (SELECT row_number() OVER (ORDER BY rank)::INTEGER, dst FROM ({1}) ORDER BY rank LIMIT 14)"
    out["expand_balanced"] = f"WITH {ranked} " + expand.format("ASIA", "SELECT * FROM nb WHERE src = 'ASIA' AND rank <= 20")
    out["expand_diverse"] = f"WITH {ranked} " + expand.format("NATION_2", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rank) AS k FROM nb WHERE src = 'NATION_2' AND rank <= 20) WHERE k <= 3")
    out["entity_clusters"] = f"""WITH RECURSIVE {adj}, s AS (SELECT name, ord FROM e WHERE ord < 1000000), l AS (SELECT DISTINCT a.ord AS a, b.ord AS b FROM adj JOIN s a ON a.name = src JOIN s b ON b.name = dst),
reach(a, b) AS (SELECT ord, ord FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b) SELECT name, min(b)::BIGINT AS cluster FROM reach JOIN s ON s.ord = reach.a GROUP BY name"""
    out["relationship_summary"] = f"SELECT relationship_type, count(*) AS n FROM ({gr}) GROUP BY 1"

    # traversal: two levels of bounded breadth-first search, each row processed while there is room
    def bfs(seeds: str, most: int) -> str:
        fields = "source_entity, target_entity, relationship_type, description, confidence"
        both = f"SELECT source_entity AS src, target_entity AS dst, 0 AS dir, {fields}, ord FROM r UNION ALL SELECT target_entity, source_entity, 1, {fields}, ord FROM r"
        text = f"""e AS ({ve}), r AS ({vr}), b AS ({both}),
nb AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, ord, dir) AS rank FROM b WHERE dst IN (SELECT name FROM e)) WHERE rank <= 5),
given AS ({seeds}), f0 AS (SELECT row_number() OVER (ORDER BY pos) AS pos, name FROM given WHERE name IN (SELECT name FROM e))"""
        seen = "SELECT name FROM f0"
        for level in (1, 2):
            text += f""",
t{level} AS (SELECT nb.*, f.pos, row_number() OVER (ORDER BY f.pos, nb.rank) AS i FROM f{level - 1} f JOIN nb ON nb.src = f.name),
n{level} AS (SELECT *, (dst NOT IN ({seen}) AND row_number() OVER (PARTITION BY dst ORDER BY i) = 1)::INTEGER AS fresh FROM t{level}),
c{level} AS (SELECT *, (SELECT count(*) FROM ({seen})) + coalesce(sum(fresh) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n{level}),
p{level} AS (SELECT * FROM c{level} WHERE before < {most}),
f{level} AS (SELECT row_number() OVER (ORDER BY i) AS pos, dst AS name FROM p{level} WHERE fresh = 1)"""
            seen += f" UNION ALL SELECT name FROM f{level}"
        return text + f""",
nodes AS (SELECT row_number() OVER (ORDER BY depth, pos) - 1 AS ord, depth, name, concat(CASE WHEN depth = 0 THEN 'seed' ELSE concat('depth', depth) END, ':', name) AS tag
  FROM (SELECT 0 AS depth, * FROM f0 UNION ALL SELECT 1, * FROM f1 UNION ALL SELECT 2, * FROM f2)),
every AS (SELECT 1 AS level, i, {fields} FROM p1 UNION ALL SELECT 2, i, {fields} FROM p2),
firsts AS (SELECT {fields}, min(level * 1000000 + i) AS spot FROM every GROUP BY ALL),
edges AS (SELECT row_number() OVER (ORDER BY spot) - 1 AS ord, {fields} FROM firsts),
depth AS (SELECT CASE WHEN n1 = 0 OR n0 + n1 >= {most} THEN 0 WHEN n2 = 0 OR n0 + n1 + n2 >= {most} THEN 1 ELSE 2 END AS depth FROM (SELECT (SELECT count(*) FROM f0) AS n0, (SELECT count(*) FROM f1) AS n1, (SELECT count(*) FROM f2) AS n2))"""

    pair_seeds = bfs("SELECT * FROM (VALUES (0, 'vec_0'), (1, 'vec_3'), (2, 'nobody')) t(pos, name)", 20)
    out["bfs_nodes"] = f"WITH {pair_seeds} SELECT ord, depth, name, tag FROM nodes"
    out["bfs_edges"] = f"WITH {pair_seeds} SELECT * FROM edges"
    first = f"SELECT * FROM (SELECT name, ord, row_number() OVER (ORDER BY ord) AS k FROM ({ve})) WHERE k <= 20"
    named = " OR ".join(f"contains(lower(name), {_lit(w)})" for w in "what is vec_1 like".split())
    found = f"SELECT ord AS pos, name FROM (SELECT *, {named} AS hit, row_number() OVER (PARTITION BY {named} ORDER BY ord) AS place FROM ({first})) x WHERE hit AND place <= 3 OR k = 1 AND NOT EXISTS (SELECT 1 FROM ({first}) WHERE {named})"
    out["graph_only"] = f"WITH {bfs(found, 10)} SELECT ord, depth, name, tag FROM nodes"
    hits = f"SELECT row_number() OVER (ORDER BY similarity DESC, ord) - 1 AS i, name, similarity FROM ({ents}) WHERE similarity >= 0.3 ORDER BY i LIMIT 5"
    hybrid = f"h AS ({hits}), {bfs('SELECT i AS pos, name FROM h', 10)}"
    boosted = f"{_ratio(X.QUERY, 'v.name')} * 0.3 + {_ratio(X.QUERY, 'v.description')} * 0.2"
    out["hybrid_retrieve"] = f"""WITH {hybrid},
s AS (SELECT coalesce(h.name, n.name) AS name, coalesce(h.i, n.ord + 1000) AS spot, CASE WHEN h.i IS NULL THEN greatest(0.1, 0.8 - 0.05 * n.ord) ELSE h.similarity * (1.0 - 0.1 * h.i) + 0.5 + CASE WHEN n.ord IS NULL THEN 0 ELSE 0.3 END END AS score,
  CASE WHEN h.i IS NULL THEN 'traversal' WHEN n.ord IS NULL THEN 'embedding' ELSE 'both' END AS source FROM h FULL JOIN nodes n ON n.name = h.name),
a AS (SELECT s.name, s.spot, s.source, round(s.score::DOUBLE + {boosted}, 6) AS score FROM s JOIN e v ON v.name = s.name)
SELECT row_number() OVER (ORDER BY score DESC, spot) - 1 AS ord, name, score, source FROM a ORDER BY ord LIMIT 10"""
    out["hybrid_relationships"] = f"WITH {hybrid} SELECT * FROM edges"
    sure = "least(1.0, coalesce((SELECT avg(similarity) FROM h), 0.3) + least(0.2, 0.02 * (SELECT count(*) FROM nodes)) + least(0.1, 0.01 * (SELECT count(*) FROM edges)))"
    out["retrieval_confidence"] = f"WITH {hybrid} SELECT round({sure}, 6)::DOUBLE AS confidence, (SELECT count(*) FROM nodes) AS entities, depth FROM depth"

    # retrieval
    out["embedding_only"] = f"SELECT row_number() OVER (ORDER BY similarity DESC, ord) - 1 AS ord, name, similarity FROM (SELECT * FROM ({ents}) WHERE similarity >= 0 ORDER BY similarity DESC, ord LIMIT 10)"
    boost = f"{_ratio(X.QUERY, 'name')} * 0.3 + {_ratio(X.QUERY, 'description')} * 0.2"
    out["relevance_boost"] = f"SELECT name, round({boost}, 6) AS boost FROM ({ve})"
    out["rank_combine"] = f"""WITH h AS (SELECT * FROM (VALUES ('vec_0', 0.9::DOUBLE, 0), ('vec_1', 0.6, 1), ('vec_2', 0.4, 2)) t(name, sim, i)), w AS (SELECT * FROM (VALUES (0, 'vec_1'), (1, 'vec_9'), (2, 'vec_0'), (20, 'vec_30')) t(j, name)),
b AS (SELECT name, CASE WHEN i IS NULL THEN greatest(0.1, 0.8 - 0.05 * j) ELSE sim * (1 - 0.1 * i) + 0.5 + CASE WHEN j IS NULL THEN 0 ELSE 0.3 END END AS s, CASE WHEN i IS NULL THEN 'traversal' WHEN j IS NULL THEN 'embedding' ELSE 'both' END AS source FROM h FULL JOIN w USING (name))
SELECT b.name, round(s::DOUBLE + {boost.replace('name', 'v.name')}, 6) AS score, source FROM b JOIN ({ve}) v ON v.name = b.name"""
    out["induced_relationships"] = f"WITH s AS (SELECT name FROM ({ve}) WHERE type IN ('L3', 'L5', 'L8')) SELECT source_entity, target_entity, relationship_type, ord FROM ({vr}) WHERE source_entity IN (SELECT name FROM s) AND target_entity IN (SELECT name FROM s)"
    out["related_chunks"] = f"""WITH c AS ({chunks}), o AS (SELECT id, ord, 0 AS k FROM c WHERE id IN (SELECT chunk FROM ({ve}) WHERE ord IN (41, 82, 7)) ORDER BY ord LIMIT 5),
n AS (SELECT id, ord, 1 AS k FROM c ORDER BY similarity DESC, ord LIMIT (SELECT greatest(0, 5 - count(*)) FROM o)) SELECT id FROM (SELECT * FROM o UNION ALL SELECT * FROM n WHERE id NOT IN (SELECT id FROM o) ORDER BY k, ord LIMIT 5)"""
    out["query_expansion"] = f"""WITH h AS (SELECT * FROM ({ents}) WHERE similarity >= 0 ORDER BY similarity DESC, ord LIMIT 3)
SELECT DISTINCT term FROM (SELECT unnest(string_split(name, ' ')) AS term FROM h UNION ALL SELECT unnest(string_split(description, ' ')[1:5]) FROM h UNION ALL SELECT unnest(string_split({_lit(X.QUERY)}, ' ')))"""
    out["retrieval_stats"] = f"""SELECT * FROM (SELECT count(*) AS total_entities, string_agg(DISTINCT type, ',' ORDER BY type) AS entity_types FROM ({ve})), (SELECT count(*) AS total_relationships, string_agg(DISTINCT relationship_type, ',' ORDER BY relationship_type) AS relationship_types FROM ({vr})),
(SELECT count(*) AS total_chunks FROM ({vc})), (SELECT round((SELECT count(*) FROM ({vr}))::DOUBLE / count(*), 6) AS avg_entity_connections FROM ({ve}))"""

    # keyword retrieval
    out["entity_index"] = f"SELECT lower(name) AS key, arg_max(name, ord) AS name, arg_max(type, ord) AS type, min(ord) AS at FROM ({ge}) GROUP BY 1"
    out["type_index"] = f"SELECT type, count(*) AS n FROM ({ge}) GROUP BY 1"
    out["find_entities"] = f"SELECT name, type FROM ({ge}) WHERE contains({_lit(Q.QUESTION.lower())}, lower(name))"
    hop = "SELECT f.start, CASE WHEN s.name IS NOT NULL THEN r.target_entity ELSE r.source_entity END AS name FROM r CROSS JOIN (SELECT DISTINCT start FROM {0}) f LEFT JOIN {0} s ON s.start = f.start AND s.name = r.source_entity LEFT JOIN {0} t ON t.start = f.start AND t.name = r.target_entity WHERE s.name IS NOT NULL OR t.name IS NOT NULL"
    hops = f"h1 AS ({hop.format('h0')}), h2 AS ({hop.format('h1d')})".replace(", h2", ", h1d AS (SELECT DISTINCT * FROM h1), h2")
    out["related_entities"] = f"WITH r AS ({gr}), h0 AS (SELECT * FROM (VALUES ('ASIA', 'ASIA'), ('ATLANTIS', 'ATLANTIS')) t(start, name)), {hops} SELECT DISTINCT start, name FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)"
    out["keyword_context"] = f"""WITH r AS ({vr}), h0 AS (SELECT name AS start, name FROM ({ve}) WHERE contains('is vec_1 or vec_2 near?', lower(name)) ORDER BY ord LIMIT 5), {hops},
m AS (SELECT DISTINCT name FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) ORDER BY name LIMIT 10) SELECT m.name AS entity, c.id AS source FROM m JOIN ({vc}) c ON contains(lower(c.text), lower(m.name))"""
    out["entity_mentions"] = f"SELECT t.name AS entity, c.id AS source FROM (VALUES ('vec_7'), ('VEC_12')) t(name) JOIN ({vc}) c ON contains(lower(c.text), lower(t.name))"

    # result sets and prompts
    out["filter_by_type"] = f"SELECT ord, name, type FROM ({me}) WHERE type IN ('Brand#11', 'Brand#23')"
    out["dedupe_results"] = f"SELECT min(ord) AS ord, name FROM ({me}) GROUP BY name"
    out["merge_traversals"] = f"""SELECT part, ord, source_entity, target_entity, relationship_type, 2 AS depth FROM (SELECT *, row_number() OVER (PARTITION BY source_entity, target_entity, relationship_type ORDER BY part, ord) AS k
FROM (SELECT 0 AS part, * FROM ({mr}) WHERE relationship_type = 'R' UNION ALL SELECT 1, * FROM ({mr}))) WHERE k = 1"""
    out["merge_traversal_entities"] = f"SELECT part, ord, name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY part, ord) AS k FROM (SELECT 0 AS part, name, ord FROM ({me}) WHERE type > 'Brand#2' UNION ALL SELECT 1, name, ord FROM ({me}))) WHERE k = 1"
    lines = "(SELECT string_agg(line, chr(10) ORDER BY ord) FROM (SELECT ord, {0} AS line FROM ({1}) ORDER BY ord LIMIT {2}))"
    whole = "concat('Relevant Entities:', chr(10), {}, chr(10), chr(10), 'Relevant Relationships:', chr(10), {}, chr(10), chr(10), 'Relevant Context:', chr(10), {})".format(
        lines.format("concat('- ', name, ' (', type, '): ', description)", ve, 10),
        lines.format("concat('- ', source_entity, ' → ', relationship_type, ' → ', target_entity)", vr, 5),
        lines.format("CASE WHEN length(text) > 200 THEN concat('- ', substring(text, 1, 200), '...') ELSE concat('- ', text) END", vc, 3),
    )
    out["format_context"] = f"SELECT CASE WHEN length(t) > 1200 THEN concat(substring(t, 1, 1200), '...') ELSE t END AS context FROM (SELECT {whole} AS t)"

    batch = f"SELECT id AS chunk_id, CAST(regexp_extract(id, 'd([0-9]+)_', 1) AS BIGINT) * 100000 + chunk_index AS ord, concat('(', string_split({_collapse(_strip('text'))}, ' ')[1], '<|>concept<|>first word)##<|COMPLETE|>') AS response FROM ({out['chunk_documents']})"
    out["extract_batch"] = parts.replace(f"({rs})", f"({batch})") + " SELECT ord, f[1] AS name, upper(f[2]) AS type FROM p WHERE len(f) = 3 AND f[1] <> '' AND f[2] <> ''"

    # prompts: lines of the first rows, each cut at a word
    def lines_of(line: str, rows: str, most: int) -> str:
        return f"(SELECT string_agg(line, chr(10) ORDER BY ord) FROM (SELECT ord, {line} AS line FROM ({rows}) ORDER BY ord LIMIT {most}))"

    entity_line = f"concat('- ', name, ' (', type, '): ', {_short('description', 120)})"
    edge_line = f"concat('- ', source_entity, ' --[', relationship_type, ']--> ', target_entity, ': ', {_short('description', 100)})"
    chunk_line = f"concat('[Chunk ', id, '] ', {_short('text', 400)})"
    twelve = ve.replace("concat('item of label ', CAST(label AS STRING)) AS description", "array_to_string(list_transform(range(12), lambda x: concat('item of label ', CAST(label AS STRING))), ' ') AS description")
    out["prompt_entities"] = f"SELECT {lines_of(entity_line, twelve, 10)} AS text"
    out["prompt_relationships"] = f"SELECT {lines_of(edge_line, vr, 15)} AS text"
    out["prompt_chunks"] = f"SELECT {lines_of(chunk_line, vc, 3)} AS text"
    cited = f"""{out['hybrid_retrieve'][: out['hybrid_retrieve'].index('SELECT row_number() OVER (ORDER BY score DESC, spot)')]},
final AS (SELECT row_number() OVER (ORDER BY score DESC, spot) - 1 AS ord, name, score FROM a ORDER BY ord LIMIT 10),
k AS ({chunks}), own AS (SELECT id, text, ord, 0 AS place FROM k WHERE id IN (SELECT chunk FROM e WHERE name IN (SELECT name FROM final WHERE ord < 5)) ORDER BY ord LIMIT 5),
near AS (SELECT id, text, ord, 1 AS place FROM k ORDER BY similarity DESC, ord LIMIT (SELECT greatest(0, 5 - count(*)) FROM own)),
got AS (SELECT * FROM own UNION ALL SELECT * FROM near WHERE id NOT IN (SELECT id FROM own) ORDER BY place, ord LIMIT 5)"""
    tail = "Use the entities, relationships and passages above to answer the user query comprehensively."
    heads = ("## Relevant Entities", "## Key Relationships", "## Supporting Passages")
    bodies = (lines_of(entity_line, "SELECT f.ord, e.name, e.type, e.description FROM final f JOIN e ON e.name = f.name", 10), lines_of(edge_line, "SELECT * FROM edges", 15), lines_of(chunk_line, "SELECT * FROM got", 3))
    sections = "".join(f", {_lit(h)}, chr(10), {b}, chr(10), chr(10)" for h, b in zip(heads, bodies, strict=True))
    out["augmented_prompt"] = f"{cited} SELECT concat('## User Query', chr(10), {_lit(X.QUERY)}, chr(10), chr(10){sections}, '## Instruction', chr(10), {_lit(tail)}) AS prompt"

    # the whole build, over the chunks' first two words
    first = "regexp_replace(lower(list_filter(string_split(" + _collapse("text") + ", ' '), lambda w: w <> '')[{k}]), '[^a-z0-9]', '', 'g')"
    found = f"""SELECT id AS chunk, CAST(regexp_extract(id, 'd([0-9]+)_', 1) AS BIGINT) * 100000 + chunk_index AS spot, coalesce({first.replace('{k}', '1')}, '') AS w1, coalesce({first.replace('{k}', '2')}, '') AS w2 FROM ({out['chunk_documents']})"""
    words = f"SELECT w1 AS name, 'T' || length(w1) AS type, 'word 0' AS description, chunk, 1.0::DOUBLE AS confidence, spot * 10000 AS ord FROM ({found}) WHERE w1 <> '' UNION ALL SELECT w2, 'T' || length(w2), 'word 1', chunk, 1.0, spot * 10000 + 1 FROM ({found}) WHERE w2 <> ''"
    pairs = f"SELECT w1, w2 FROM ({found}) WHERE w1 <> '' AND w2 <> ''"
    out["build_graph"] = greedy.replace(f"({me})", f"({words})") + f""" SELECT (SELECT count(*) FROM ({docs})) AS docs, (SELECT count(*) FROM ({out['chunk_documents']})) AS chunks, (SELECT count(*) FROM e) AS entities_found, (SELECT count(*) FROM ({pairs})) AS relationships_found,
(SELECT count(DISTINCT leader) FROM c) AS entities, (SELECT count(*) FROM (SELECT DISTINCT {_entity_norm('w1')}, {_entity_norm('w2')} FROM ({pairs}))) AS relationships, 1::BIGINT AS prompts"""

    # sources and sinks
    out["graph_json_roundtrip"] = parts + " SELECT 'json' AS kind, f[1] AS name, upper(f[2]) AS type, f[3] AS description, chunk_id AS chunks, 1.0::DOUBLE AS confidence FROM p WHERE len(f) = 3 AND f[1] <> '' AND f[2] <> '' UNION ALL SELECT 'json', concat(f[1], '|', f[3]), upper(f[2]), f[4], chunk_id, 1.0 FROM p WHERE len(f) = 4 AND f[1] <> '' AND f[2] <> '' AND f[3] <> ''"
    out["graph_parquet_roundtrip"] = f"""SELECT 'parquet' AS kind, name, type, description, chunk AS chunks, round(confidence, 6) AS confidence FROM ({me})
UNION ALL SELECT 'parquet', concat(source_entity, '|', target_entity), relationship_type, description, chunk, round(confidence, 6) FROM ({mr})"""
    out["src_dir"] = f"SELECT id, {_clean('content')} AS content FROM ({docs})"
    out["docs_sample"] = f"SELECT id, ord FROM ({docs}) ORDER BY ord LIMIT 25"
    return out
