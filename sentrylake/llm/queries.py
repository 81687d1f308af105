"""Registered queries of the training-data operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import byte_cnn, collocations, ctw, debruijn, divergence, licences, line_crf, merkle, mixing, packing, topk, trie_join, url_filter

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_divergence_rules(spark, sf_dir):
    return divergence.quality_rules(_table(spark, sf_dir, "documents"))


def op2_line_crf(spark, sf_dir):
    return line_crf.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_debruijn_dedup(spark, sf_dir):
    return debruijn.dedup_report(_table(spark, sf_dir, "documents"))


def op5_topk_search(spark, sf_dir):
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op6_context_tree(spark, sf_dir):
    return ctw.score_texts(_table(spark, sf_dir, "documents"))


def op7_trie_jaccard(spark, sf_dir):
    return trie_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op9_entropy_mixing(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("source"), "rate")


def op10_byte_cnn_language(spark, sf_dir):
    return byte_cnn.identify_language(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark, sf_dir):
    return merkle.merkle_proofs(_table(spark, sf_dir, "documents"))


def op12_licence_index(spark, sf_dir):
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op13_rollup_collocations(spark, sf_dir):
    return collocations.mine_phrases(_table(spark, sf_dir, "documents"))


def _licence_sql() -> str:
    """Templates and phrases as rows; alignments by a join of all words, without an index."""
    rows = lambda items: ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in items)
    templates = [(t, x.label, i, w) for t, x in enumerate(licences.TEMPLATES) for i, w in enumerate(x.words.split())]
    keys = [(t, k) for t, x in enumerate(licences.TEMPLATES) for k in x.keys]
    phrases = [(p, j, w, len(p.split())) for p in dict.fromkeys([*licences.PHRASES, *(k for _, k in keys)]) for j, w in enumerate(p.split())]
    return rf"""
        WITH t(tid, label, i, word) AS (VALUES {rows(templates)}), k(tid, phrase) AS (VALUES {rows(keys)}), p(phrase, j, word, len) AS (VALUES {rows(phrases)}), b(phrase, label) AS (VALUES {rows(licences.PHRASES.items())}),
        d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        w AS (SELECT rid, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM d),
        v AS (SELECT word FROM t UNION SELECT word FROM p),
        f AS (SELECT v.word, count(DISTINCT rid) AS df FROM v LEFT JOIN w USING (word) GROUP BY v.word),
        g AS (SELECT word, 1 + CAST(round(1024 * log2(((SELECT count(*) FROM documents) + 1) / (df + 1))) AS BIGINT) AS weight FROM f),
        total AS (SELECT tid, any_value(label) AS label, sum(weight) AS total, count(*) AS len FROM t JOIN g USING (word) GROUP BY tid),
        al AS (SELECT rid, tid, pos - i AS s, sum(weight) AS matched FROM w JOIN t USING (word) JOIN g USING (word) GROUP BY ALL),
        good AS (SELECT rid, tid, s, matched, label, total, len FROM al JOIN total USING (tid) WHERE 100 * matched >= {licences.LEAST_SHARE} * total),
        occ AS (SELECT rid, phrase, pos - j AS at0, any_value(len) AS n FROM w JOIN p USING (word) GROUP BY rid, phrase, pos - j HAVING count(*) = any_value(len)),
        kept AS (SELECT * FROM good x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.tid = x.tid AND NOT EXISTS
            (SELECT 1 FROM occ WHERE occ.rid = x.rid AND occ.phrase = k.phrase AND at0 >= x.s - {licences.SLACK} AND at0 + n <= x.s + x.len + {licences.SLACK}))),
        base AS (SELECT rid, count(*) AS n_base, min(at0) AS first_word, max(at0) AS last_word FROM occ JOIN b USING (phrase) GROUP BY rid),
        names AS (SELECT rid, label, TRUE AS own FROM occ JOIN b USING (phrase) UNION SELECT rid, label, FALSE FROM kept),
        said AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (own) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM names GROUP BY rid),
        best AS (SELECT rid, max(matched / total) AS score FROM kept GROUP BY rid)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
            CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END AS DOUBLE) AS score
        FROM d LEFT JOIN base USING (rid) LEFT JOIN said USING (rid) LEFT JOIN best USING (rid)
    """


QUERIES = {f.__name__: f for f in (op1_divergence_rules, op2_line_crf, op3_best_fit_packing, op4_debruijn_dedup, op5_topk_search, op6_context_tree, op7_trie_jaccard, op8_url_filter, op9_entropy_mixing, op10_byte_cnn_language, op11_merkle_manifest, op12_licence_index, op13_rollup_collocations)}
ORACLES: dict[str, str] = {
    "op5_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5
    """,
    "op4_debruijn_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM d WHERE len(w) >= 20),
        h AS (SELECT doc_id, pos, sha256(array_to_string(w[pos : pos + 19], ' ')) AS key FROM p),
        f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) > 1 AS later FROM h),
        g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM f WHERE later),
        o AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
        k AS (SELECT o.doc_id, count(*) FILTER (g.pos IS NOT NULL) AS gone, string_agg(o.word, ' ' ORDER BY o.pos) FILTER (g.pos IS NULL) AS kept
            FROM o LEFT JOIN g ON o.doc_id = g.doc_id AND o.pos = g.pos GROUP BY o.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op7_trie_jaccard": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
        a AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS pos FROM d WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[pos : pos + 3], ' ') AS g FROM a),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)
    """,
    "op8_url_filter": r"""
        WITH RECURSIVE t AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
        u AS (SELECT page_id, translate(regexp_extract(coalesce(tail, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(tail, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM t),
        v AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
            WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
            list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS seg FROM u),
        q AS (SELECT *, CASE rule WHEN 'example.org/en/1' THEN 'block' WHEN 'example.org/es/' THEN 'block' WHEN 'com/de/' THEN 'block' WHEN 'com/fr/' THEN 'allow' WHEN 'org/' THEN 'allow' END AS ruled FROM v),
        leaf AS (SELECT host, seg, count(*) AS n, count(ruled) AS l, count(*) FILTER (ruled = 'block') AS b FROM q GROUP BY ALL),
        lv AS (SELECT host, seg, n, unnest(range(1, len(seg) + 1)) AS i FROM leaf),
        sib AS (SELECT host, i, seg[1 : i - 1] AS par, seg[i] AS s, sum(n) AS n FROM lv GROUP BY ALL),
        tot AS (SELECT host, i, par, sum(n) AS a, count(*) FILTER (s <> '*') AS kids FROM sib GROUP BY ALL),
        wild AS (SELECT host, i, par, s FROM sib JOIN tot USING (host, i, par) WHERE kids >= 20 AND s <> '*' AND n < 0.02 * a),
        gs AS (SELECT lv.host, lv.seg, list(CASE WHEN w.s IS NULL THEN lv.seg[lv.i] ELSE '*' END ORDER BY lv.i) AS g FROM lv LEFT JOIN wild w ON w.host = lv.host AND w.i = lv.i AND w.par = lv.seg[1 : lv.i - 1] AND w.s = lv.seg[lv.i] GROUP BY lv.host, lv.seg),
        named AS (SELECT leaf.host, leaf.seg, l, b, coalesce(g, []) AS g FROM leaf LEFT JOIN gs ON gs.host = leaf.host AND gs.seg = leaf.seg),
        tm AS (SELECT host, g, sum(l) AS l, sum(b) AS b FROM named GROUP BY ALL),
        al AS (SELECT least(0.5, (sum(b) + 1) / (sum(l) + 2)) AS p_all FROM tm),
        ho AS (SELECT host, (sum(b) + 2.0::DOUBLE * (SELECT p_all FROM al)) / (sum(l) + 2.0::DOUBLE) AS p FROM tm GROUP BY host),
        nd AS (SELECT host, g, l, b, unnest(range(1, len(g) + 1)) AS i FROM tm),
        cn AS (SELECT host, i, g[1 : i - 1] AS par, g[1 : i] AS node, sum(l) AS l, sum(b) AS b FROM nd GROUP BY ALL),
        pr AS (SELECT host, i, par, sum(l) AS lp, sum(b) / nullif(sum(l), 0) AS rate FROM cn GROUP BY ALL),
        sm AS (SELECT cn.*, coalesce(abs(b - l * rate) <= 1.96::DOUBLE * sqrt(l * rate * (1 - rate)), TRUE) AS alike FROM cn JOIN pr USING (host, i, par)),
        ef AS (SELECT host, i, node, CASE WHEN alike THEN sum(l) OVER w ELSE l END AS l, CASE WHEN alike THEN sum(b) OVER w ELSE b END AS b FROM sm WINDOW w AS (PARTITION BY host, i, par, alike)),
        pu AS (SELECT tm.host, tm.g, 0::BIGINT AS i, ho.p FROM tm JOIN ho USING (host)
            UNION ALL SELECT pu.host, pu.g, pu.i + 1, (e.b + 2.0::DOUBLE * pu.p) / (e.l + 2.0::DOUBLE) FROM pu JOIN ef e ON e.host = pu.host AND e.i = pu.i + 1 AND e.node = pu.g[1 : pu.i + 1] WHERE pu.i < len(pu.g))
        SELECT q.page_id, q.host, q.path, q.rule, coalesce(ruled, CASE WHEN pu.p >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(named.g, '/') AS template, pu.p AS purity
        FROM q JOIN named ON named.host = q.host AND named.seg = q.seg JOIN pu ON pu.host = named.host AND pu.g = named.g AND pu.i = len(named.g)
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE v AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS nc,
            list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
                lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) & 1 AS odd FROM documents),
        f AS (SELECT doc_id, source, text, odd = 1 AS even, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(nc) || ':' || nc, '-') AS head,
            CASE WHEN odd = 1 THEN replace(text, chr(10), '') ELSE text END AS now FROM v),
        l AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS now FROM f),
        p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
        lv AS (SELECT tree, 0 AS level, pos, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM p
            UNION ALL SELECT tree, any_value(level) + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM lv WHERE n > 1 GROUP BY tree, pos // 3),
        sub AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
        tv AS (SELECT 0 AS level, pos, subroot AS d, n FROM sub UNION ALL SELECT any_value(level) + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tv WHERE n > 1 GROUP BY pos // 3),
        nodes AS (SELECT tree, level, pos, d, n FROM lv WHERE n > 1 UNION ALL SELECT '', level, pos, d, n FROM tv WHERE n > 1),
        runs AS (SELECT tree, level, pos // 3 AS up, list(d ORDER BY pos) AS ds FROM nodes GROUP BY ALL),
        sides AS (SELECT nodes.tree, nodes.level, nodes.pos, array_to_string(ds[1 : pos % 3], '') AS a, array_to_string(ds[pos % 3 + 2 : 3], '') AS b FROM nodes JOIN runs ON runs.tree = nodes.tree AND runs.level = nodes.level AND runs.up = nodes.pos // 3),
        w AS (SELECT doc_id, tree AS own, leaf, pos AS place, tree, 0 AS level, pos, now AS h, '' AS proof FROM p
            UNION ALL SELECT doc_id, own, leaf, place, w.tree, w.level + 1, w.pos // 3, sha256(a || h || b), proof || a || b FROM w JOIN sides s ON s.tree = w.tree AND s.level = w.level AND s.pos = w.pos),
        top AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY own, place ORDER BY level DESC) = 1),
        x AS (SELECT doc_id, own, leaf, place, '' AS tree, 0 AS level, sub.pos AS pos, h, proof, subroot FROM top JOIN sub ON sub.tree = own
            UNION ALL SELECT doc_id, own, leaf, place, '', x.level + 1, x.pos // 3, sha256(a || h || b), proof || a || b, subroot FROM x JOIN sides s ON s.tree = '' AND s.level = x.level AND s.pos = x.pos),
        z AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY own, place ORDER BY level DESC) = 1),
        r AS (SELECT d AS root FROM tv WHERE n = 1), o AS (SELECT tree, min(place) AS lowest, count(*) AS n FROM (SELECT tree, pos AS place FROM p) GROUP BY tree),
        g AS (SELECT tree, coalesce(sum(n) OVER (ORDER BY tree ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM o)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified, CAST(off + place AS BIGINT) AS leaf_rank, CAST(length(proof) // 64 AS INTEGER) AS proof_length FROM z, r JOIN g ON TRUE WHERE g.tree = z.own
    """,
    "op12_licence_index": _licence_sql(),
    "op13_rollup_collocations": r"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
        p AS (SELECT lang, unnest(ps) AS piece FROM t), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        u AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        f AS (SELECT lang, ws[i : i + k - 1] AS ph, k, count(*) AS f FROM u, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, ph, k, f AS a, array_to_string(ph, ' ') AS phrase FROM f WHERE k > 1 AND f >= 100),
        s AS (SELECT lang, ph, k, a, phrase, unnest(range(1, k)) AS j FROM c),
        x AS (SELECT s.lang, s.phrase, s.k, s.a, s.j, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * s.a * n.n) // (l.f::HUGEINT * r.f) AS score
            FROM s JOIN f l ON l.lang = s.lang AND l.ph = s.ph[1 : s.j] JOIN f r ON r.lang = s.lang AND r.ph = s.ph[s.j + 1 :] JOIN n ON n.lang = s.lang),
        m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        k AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = m.lang AND c.k > m.k AND 100 * c.a >= 100 * m.a AND contains(' ' || c.phrase || ' ', ' ' || m.phrase || ' '))),
        o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM k)
        SELECT * FROM o WHERE rank <= 2000
    """,
}
