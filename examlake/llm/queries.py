"""The numbered operators as queries over their whole tables; each takes (spark, sf_dir).

A query imports its operator when it runs, so a driver holds in memory only what it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table


def op10_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without the strings of 100 bytes that occur earlier."""
    from .suffixes import repeated_strings

    return repeated_strings(table(spark, sf_dir, "documents"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under context-tree weighting and under token frequencies."""
    from .ctw import scored

    return scored(table(spark, sf_dir, "documents"))


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 1024 tokens over all documents, each holding every source in proportion."""
    from .packing import packed_sequences

    return packed_sequences(table(spark, sf_dir, "documents"))


def op6_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of all documents, from one encoding of each."""
    from .attribution import section_tokens

    return section_tokens(table(spark, sf_dir, "documents"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of all documents stored as audio."""
    from .audio import audio_features, stored_features, stored_media

    return audio_features(stored_features(stored_media(table(spark, sf_dir, "documents"))))


def op9_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written as archives and read back."""
    from .warc import read_archives, write_archives

    rows = read_archives(write_archives(table(spark, sf_dir, "pages")), payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    from .mainhtml import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op5_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that any document contains, also with other numbers, names and units."""
    from .decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_radix_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms are from every other source's of its language, and the terms most typical of it."""
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_partition_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, each rebuilt with a head that up to a hundred share."""
    from .prefixes import placed_turns, prefix_trie, rebuilt

    return prefix_trie(*rebuilt(placed_turns(table(spark, sf_dir, "conversations"))))


def op13_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, with parts of credentials that complete each other."""
    from .credentials import credentials

    return credentials(table(spark, sf_dir, "documents")).drop("parts")


QUERIES = {"op5_template_windows": op5_template_windows, "op1_tree_scoring": op1_tree_scoring, "op2_noisy_channel": op2_noisy_channel, "op9_splittable_warc": op9_splittable_warc, "op6_token_attribution": op6_token_attribution, "op7_audio_features": op7_audio_features, "op8_mixture_packing": op8_mixture_packing, "op3_context_tree": op3_context_tree, "op4_suffix_array": op4_suffix_array, "op10_superminhash": op10_superminhash, "op11_radix_tries": op11_radix_tries, "op12_partition_refinement": op12_partition_refinement, "op13_credential_linking": op13_credential_linking}
_SETS = r"""low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM low)"""
#: 160 bits of a digest in hexadecimal, five digits at a time as four letters of base 32.
_BASE32 = "array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr({0}, i * 5 + 1, 5) AS INTEGER) >> b) & 31 AS BIGINT) + 1, 1)), '')), '')"
#: CRC-32 of a decimal number in SQL: eight times a shift and a division by the polynomial for each of its bytes.
_CRC = "(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda acc, b: list_reduce(list_concat([xor(acc, b)], list_transform(range(8), lambda i: CAST(0 AS BIGINT))), lambda u, z: xor(u >> 1, (u & 1) * 3988292384))), 4294967295))"


def _credentials_sql() -> str:
    """Spans from what lies between matches, and the nearness of parts by joining every two of a scope."""
    from .credentials import BREAK, KINDS, REACH, STRONG

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    found = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, {quoted(name)} AS name, {quoted(role)} AS role, {least} AS least, list_transform(regexp_split_to_array(text, {quoted(pattern)}), lambda x: length(x)) AS gaps, "
        + ", ".join(f"list_transform(regexp_extract_all(text, {quoted(pattern)}, {g}), lambda x: length(x)) AS {c}" for g, c in enumerate(("sizes", "leads", "vals")))
        + " FROM d"
        for k, (name, (role, pattern, least)) in enumerate((KINDS | {"break": ("", BREAK, 0)}).items())
    )
    near = f"greatest(a.start - b.stop, b.start - a.stop) <= {REACH}"
    has = lambda test: f"coalesce(bool_or(({test}) AND {near}), false)"
    strong_identifier, strong_secret = "b.strong AND b.role = 'identifier'", "b.strong AND b.role = 'secret'"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), f AS ({found}),
        m AS (SELECT r, kind, name, role, least, vals, leads, sizes, gaps, unnest(range(1, len(sizes) + 1)) AS i FROM f),
        s AS (SELECT r, kind, name, role, kind < {len(STRONG)} AS strong, list_sum(gaps[1 : i]) + list_sum(sizes[1 : i]) - sizes[i] + leads[i] AS start, list_sum(gaps[1 : i]) + list_sum(sizes[1 : i]) AS stop FROM m WHERE vals[i] >= least),
        p AS (SELECT *, (SELECT count(*) FROM s x WHERE x.r = s.r AND x.name = 'break' AND x.stop <= s.start) AS scope FROM s WHERE name <> 'break'),
        w AS (SELECT a.r, a.kind, a.start, a.stop, any_value(a.name) AS name, any_value(a.role) AS role, {has("b.role = 'identifier'")} AS i, {has("b.role = 'secret'")} AS s, {has("b.role = 'endpoint'")} AS e, {has(strong_identifier)} AS si, {has(strong_secret)} AS ss,
            coalesce(bool_or(b.strong AND b.start < a.stop AND a.start < b.stop), false) AS same FROM p a JOIN p b ON a.r = b.r AND a.scope = b.scope AND (a.start, a.kind) <> (b.start, b.kind) WHERE NOT a.strong GROUP BY 1, 2, 3, 4),
        r AS (SELECT r, kind, name, start, stop FROM p WHERE strong UNION ALL SELECT r, kind, name, start, stop FROM w WHERE CASE role WHEN 'identifier' THEN s AND (ss OR e) AND NOT same WHEN 'secret' THEN i AND (si OR e) AND NOT same ELSE i AND s AND (si OR ss) END),
        t AS (SELECT r, count(*) FILTER (WHERE name = 'assign') AS n_assign, count(*) FILTER (WHERE name = 'access') AS n_access, count(*) FILTER (WHERE name = 'hex') AS n_hex, string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) AS spans,
            string_agg(name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind) FILTER (WHERE kind < {len(STRONG)}) AS base FROM r GROUP BY 1)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (r)"""


ORACLE_SQL: dict[str, str] = {
    "op10_superminhash": f"""WITH RECURSIVE {_SETS}, items AS (SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c) UNION ALL SELECT b, a FROM common WHERE 100 * c >= 75 * (na + nb - c)),
        reach(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, low FROM reach JOIN links ON a = doc_id)
        SELECT doc_id, CAST(any_value(len(s)) AS BIGINT) AS n_shingles, min(low) AS component_id, doc_id = min(low) AS kept FROM sets JOIN reach USING (doc_id) GROUP BY doc_id""",
    "op9_splittable_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT *, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS low FROM p)
        SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32.format("hex")} AS payload_digest, CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to FROM d""",
    "op4_suffix_array": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
        again AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        edge AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM again), run AS (SELECT *, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
        runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM run GROUP BY doc_id, r), gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
        cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY 1)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)""",
    "op11_radix_tries": """WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        every AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        p AS (SELECT lang, source, term, c, 1 + 1000000000 * (CAST(c AS HUGEINT) + 2) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM every JOIN v USING (lang)),
        l AS (SELECT lang, term, 1 + 1000000000 * (CAST(sum(c) AS HUGEINT) + 2) // (sum(sum(c)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q FROM every JOIN v USING (lang) GROUP BY 1, 2),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS o, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS f FROM p a JOIN p b USING (lang, term) GROUP BY 1, 2, 3) x ON x.lang = a.lang AND x.s = a.source AND x.o = b.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN l USING (lang, term) WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= 10""",
    "op12_partition_refinement": f"""WITH s AS (SELECT conv_id, turn, role, text, sha256(length(role) || ':' || role || text) AS dig FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
        o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) AS i, dig, length(text) AS n FROM s),
        a AS (SELECT conv_id, list(struct_pack(d := dig, n := n) ORDER BY i) AS t FROM o GROUP BY 1), c AS (SELECT conv_id, t, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS base FROM a),
        f AS (SELECT c.conv_id AS c, list_concat(coalesce(b.t, [])[1 : h], c.t[h + 1 :]) AS t FROM c LEFT JOIN a b ON b.conv_id = base),
        m AS (SELECT c, len(t) AS l, unnest(range(len(t) + 1)) AS d, t FROM f), k AS (SELECT c, d, l, CASE WHEN d > 0 THEN t[d].n ELSE 0 END AS n, array_to_string(list_transform(t[1 : d], lambda x: x.d), ',') AS k, array_to_string(list_transform(t[1 : d - 1], lambda x: x.d), ',') AS up FROM m),
        node AS (SELECT d, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = l) AS ends FROM k GROUP BY 1, 2),
        child AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2), x AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (d, k)),
        sub AS (SELECT k.d, k.k, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved FROM x JOIN k ON k.c = x.conv_id AND k.d <= x.d GROUP BY 1, 2)
        SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256 FROM x JOIN sub USING (d, k) LEFT JOIN x y ON y.d = x.d - 1 AND y.k = x.up""",
    "op13_credential_linking": _credentials_sql(),
}
