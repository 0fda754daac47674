"""Checked queries: text functions, corpus analytics, files, model parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from textscan.functions import nested as NE
from textscan.functions import text as X
from textscan.operators import corpus as K
from textscan.operators import model as M
from textscan.plans.extraction_checks import quoted as q
from textscan.plans.inputs import order_values, order_values_sql, table
from textscan.sources import files as S
from textscan.sources import sinks

W = r"[\p{L}\p{N}_]"
STOPS = ["the", "of", "and", "to", "in", "de", "la", "le", "et", "und", "der", "is", "that", "que", "en"]
CORRECTIONS = {"the": "teh", "and": "adn", "la": "al", "Le": "El"}
PROMPT = "Which parts of this text need attention?"

# text with contractions, from the conversations
SPOKEN = "'I''m ' || role || ': ' || text || ' You can''t, won''t. It''s'"
REPEATED = "text || ' ' || upper(role) || ', ' || role || ' (' || role || ')'"



def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{W}+')"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{W}+|[^" + r"\p{L}\p{N}_\s]')"


def sentences_sql(text: str) -> str:
    return f"string_split(regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def special_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '[^-.,A-Za-z0-9 ]+', '', 'g'), ' +', ' ', 'g'))"


def spaces_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def stopwords_sql(text: str) -> str:
    listed = ", ".join(map(q, STOPS))
    return f"array_to_string(list_filter(string_split({spaces_sql(text)}, ' '), lambda w: w <> '' AND lower(w) NOT IN ({listed})), ' ')"


def lemmas_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform({tokens_sql(text)}, lambda w: CASE WHEN lower(w) LIKE '%ing' AND length(w) > 5 "
        "THEN regexp_replace(lower(w), 'ing$', '') ELSE w END), ' ')"
    )


def checks() -> dict:
    out: dict = {}

    def add(name, run, sql=None):
        out[name] = (run, sql)

    def on_documents(name, function, sql, column="text"):
        add(
            name,
            lambda spark, d: table(spark, d, "documents").select("doc_id", function(F.col("text")).alias(column)),
            sql and f"SELECT doc_id, {sql} AS {column} FROM documents",
        )

    def on_turns(name, expression, function, sql):
        add(
            name,
            lambda spark, d: table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{expression} AS t").select(
                "conv_id", "turn", function(F.col("t")).alias("text")
            ),
            sql and f"SELECT conv_id, turn, {sql} AS text FROM (SELECT conv_id, turn, {expression} AS t FROM conversations)",
        )

    t = "text"
    on_documents("T01_to_lowercase", X.to_lowercase, "lower(text)")
    on_documents("T02_remove_special_chars", X.remove_special_chars, special_sql(t))
    on_documents("T03_remove_special_chars_keep_hash", X.remove_special_chars_keep_hash, "regexp_replace(text, '[^-.,#A-Za-z0-9 ]+', '', 'g')")
    on_documents("T04_remove_stopwords", lambda v: X.remove_stopwords(v, STOPS), stopwords_sql(t))

    def lemmas(spark, d):
        words = table(spark, d, "documents").select(F.explode(F.transform(X.tokenize_words(F.col("text")), F.lower)).alias("token"))
        return words.filter(F.col("token").endswith("ing") & (F.length("token") > 5)).distinct().select(
            "token", F.regexp_replace("token", "ing$", "").alias("lemma")
        )

    add(
        "T05_lemmatize_words",
        lambda spark, d: K.lemmatize(table(spark, d, "documents"), "text", "doc_id", lemmas(spark, d)),
        f"SELECT doc_id, {lemmas_sql('text')} AS text FROM documents",
    )
    on_documents("T06_remove_numbers", X.remove_numbers, "regexp_replace(text, '\\d+', '', 'g')")
    on_documents("T07_remove_accents", X.remove_accents, "strip_accents(text)")
    expanded = "t"
    for short, long in (("I'm", "I am"), ("can't", "cannot"), ("won't", "will not"), ("It's", "It is")):
        expanded = f"replace({expanded}, {q(short)}, {q(long)})"
    on_turns("T08_expand_contractions", SPOKEN, X.expand_contractions, expanded)
    punctuation = r"[!-/:-@\[-`{-~]"
    words = f"string_split({spaces_sql('t')}, ' ')"
    keys = f"list_transform({words}, lambda w: lower(regexp_replace(w, {q(f'^{punctuation}+|{punctuation}+$')}, '', 'g')))"
    on_turns(
        "T09_remove_duplicates", REPEATED, X.remove_duplicates,
        f"array_to_string(list_filter({words}, lambda w, i: list_position({keys}, ({keys})[i]) = i), ' ')",
    )
    on_documents("T10_normalize_whitespace", X.normalize_whitespace, spaces_sql(t))
    on_documents("T11_remove", lambda v: X.remove(v, r"[aeiou]\w"), f"regexp_replace(text, '[aeiou]{W}', '', 'g')")
    on_documents("T12_replace", lambda v: X.replace(v, r"(\d)(\d)", r"\2-\1$"), "regexp_replace(text, '(\\d)(\\d)', '\\2-\\1$', 'g')")
    on_documents("T13_clean_text", X.clean_text, special_sql(t))
    prepared = stopwords_sql(special_sql("lower(text)"))
    add(
        "T14_prepare_text",
        lambda spark, d: K.prepare(table(spark, d, "documents"), "text", "doc_id", lemmas(spark, d), STOPS),
        f"SELECT doc_id, {lemmas_sql(prepared)} AS text FROM documents",
    )
    corrected = "array_to_string(list_transform(regexp_extract_all(text, '" + W + "+|[^\\p{L}\\p{N}_]+'), lambda w: CASE " + " ".join(
        f"WHEN w = {q(a)} THEN {q(b)}" for a, b in CORRECTIONS.items()
    ) + " " + " ".join(f"WHEN lower(w) = {q(a)} THEN {q(b)}" for a, b in CORRECTIONS.items()) + " ELSE w END), '')"
    add(
        "T15_correct_and_analyze",
        lambda spark, d: table(spark, d, "documents").select(
            "doc_id", X.correct_and_analyze(F.col("text"), CORRECTIONS).alias("r")
        ).select("doc_id", "r.text", "r.statistics.word_count", "r.statistics.unique_words"),
        f"""SELECT doc_id, trim(c, ' ' || chr(10)) AS text,
            CAST(len({words_sql("regexp_replace(c, '[^' || " + q(W[1:-1]) + " || '\\s]', '', 'g')")}) AS INTEGER) AS word_count,
            CAST(len(list_distinct({words_sql("regexp_replace(c, '[^' || " + q(W[1:-1]) + " || '\\s]', '', 'g')")})) AS INTEGER) AS unique_words
            FROM (SELECT doc_id, {corrected} AS c FROM documents)""",
    )
    flat = "string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')"
    add(
        "T16_break_text",
        lambda spark, d: table(spark, d, "documents").select("doc_id", F.posexplode(X.break_text(F.col("text"), 50)).alias("chunk", "text")),
        f"""WITH w AS (SELECT doc_id, {flat} AS w FROM documents),
            i AS (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 50.0) AS BIGINT))) AS chunk FROM w)
            SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(list_slice(w, chunk * 50 + 1, chunk * 50 + 50), ' ') AS text FROM i""",
    )
    on_turns(
        "T17_render_prompt", "text", lambda v: X.render_prompt(v, PROMPT, "['disk']", "Specific diagnostic area."),
        f"'{PROMPT}' || chr(10) || chr(10) || 'Object: ' || t || chr(10) || 'Args: [''disk'']' || chr(10) || 'Specific diagnostic area.'",
    )
    add(
        "N1_nested_normalisation",
        lambda spark, d: NE.normalize_columns(
            table(spark, d, "conversations").selectExpr(
                "conv_id", "turn", "map(upper(role), array(text), role, array(concat('  X ', turn, '  ')), 'The TEXT', array(text, role)) AS m"
            ),
            lambda c: X.normalize_whitespace(F.lower(c)), ["m"],
        ).select("conv_id", "turn", F.array_join(F.map_keys("m"), ",").alias("keys"),
                 F.array_join(F.flatten(F.map_values("m")), "|").alias("values")),
        f"""SELECT conv_id, turn, role || ',the text' AS keys,
            'x ' || turn || '|' || {spaces_sql('lower(text)')} || '|' || role AS "values" FROM conversations""",
    )
    add(
        "N2_nested_values",
        lambda spark, d: NE.normalize_columns(
            table(spark, d, "conversations").selectExpr("conv_id", "turn", "role", "map(upper(role), struct(text, array(role) AS a)) AS m"),
            X.normalize_whitespace, ["m"], keys=False,
        ).select("conv_id", "turn", F.element_at("m", F.upper("role")).alias("s"), F.map_keys("m")[0].alias("key"))
        .select("conv_id", "turn", "key", F.col("s.text").alias("text")),
        f"SELECT conv_id, turn, upper(role) AS key, {spaces_sql('text')} AS text FROM conversations",
    )
    add(
        "N3_flatten",
        lambda spark, d: table(spark, d, "orders").selectExpr(
            "o_orderkey AS id", "array(array(array(o_orderkey, o_custkey)), array(array(1), array(2, o_custkey))) AS a"
        ).transform(lambda df: df.select("id", F.array_join(NE.flatten(F.col("a"), df.schema["a"].dataType).cast("array<string>"), ",").alias("flat"))),
        "SELECT o_orderkey AS id, o_orderkey || ',' || o_custkey || ',1,2,' || o_custkey AS flat FROM orders",
    )

    # --- corpus --------------------------------------------------------------------
    exploded = f"SELECT doc_id, lang, lower(w) AS word, pos FROM (SELECT doc_id, lang, unnest({words_sql(t)}) AS w, generate_subscripts({words_sql(t)}, 1) AS pos FROM documents)"
    on_documents("A01_tokenize_words", lambda v: F.array_join(X.tokenize_words(v), "|"), f"array_to_string({words_sql(t)}, '|')")
    on_documents(
        "A02_tokenize_sentences", lambda v: F.array_join(X.tokenize_sentences(v), "|"),
        f"array_to_string({sentences_sql(t)}, '|')",
    )
    add(
        "A03_word_frequency",
        lambda spark, d: K.word_frequency(table(spark, d, "documents"), "text"),
        f'SELECT word, count(*) AS "count" FROM ({exploded}) GROUP BY word',
    )
    add(
        "A03_word_frequency_by_source",
        lambda spark, d: K.word_frequency(table(spark, d, "documents"), "text", "lang"),
        f'SELECT lang, word, count(*) AS "count" FROM ({exploded}) GROUP BY lang, word',
    )
    add(
        "A04_top_words",
        lambda spark, d: K.top_words(table(spark, d, "documents"), "text", "doc_id", 25),
        f"""SELECT word, n AS "count" FROM (SELECT word, count(*) AS n, min(doc_id * 1000000 + pos) AS f FROM ({exploded}) GROUP BY word ORDER BY n DESC, f LIMIT 25)""",
    )
    add(
        "A04_top_words_by_language",
        lambda spark, d: K.top_words_by(table(spark, d, "documents"), "text", "lang", "doc_id", 10),
        f"""WITH c AS (SELECT lang, word, count(*) AS n, min(doc_id * 1000000 + pos) AS f FROM ({exploded}) GROUP BY lang, word),
            r AS (SELECT lang, word, n, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS INTEGER) AS rank FROM c)
            SELECT lang, word, n AS "count", rank FROM r WHERE rank <= 10""",
    )
    cleaned = f"regexp_replace(b, '[^' || {q(W[1:-1])} || '\\s]', '', 'g')"
    stats_sql = f"""(SELECT doc_id, lang, source, CAST(len(w) AS INTEGER) AS word_count, CAST(len(list_distinct(w)) AS INTEGER) AS unique_words,
        CAST(CASE WHEN b = '' THEN 0 ELSE len({sentences_sql('b')}) END AS INTEGER) AS sentence_count,
        CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) ELSE 0.0 END AS avg_word_length,
        CASE WHEN b = '' THEN 0.0 ELSE list_avg(list_transform({sentences_sql('b')}, lambda x: len(list_filter(string_split(regexp_replace(x, '\\s+', ' ', 'g'), ' '), lambda y: y <> '')))) END AS avg_sentence_length
        FROM (SELECT doc_id, lang, source, b, {words_sql(cleaned)} AS w FROM (SELECT doc_id, lang, source, trim(text, ' ' || chr(10) || chr(9)) AS b FROM documents)))"""
    add(
        "A05_text_statistics",
        lambda spark, d: K.text_statistics(table(spark, d, "documents"), "text", "doc_id").select(
            "doc_id", "word_count", "unique_words", "sentence_count",
            F.round("avg_word_length", 6).alias("avg_word_length"), F.round("avg_sentence_length", 6).alias("avg_sentence_length"),
        ),
        f"""SELECT doc_id, word_count, unique_words, sentence_count, round(avg_word_length, 6) AS avg_word_length,
            round(avg_sentence_length, 6) AS avg_sentence_length FROM {stats_sql}""",
    )
    columns = """count(*) AS documents, CAST(sum(word_count) AS BIGINT) AS word_count, CAST(sum(sentence_count) AS BIGINT) AS sentence_count,
        max(unique_words) AS max_unique_words, round(avg(avg_word_length), 6) AS avg_word_length, round(avg(avg_sentence_length), 6) AS avg_sentence_length"""
    for grouping, clause in (("groupBy", "GROUP BY lang, source"), ("rollup", "GROUP BY ROLLUP (lang, source)"), ("cube", "GROUP BY CUBE (lang, source)")):
        add(
            f"A06_corpus_statistics_{grouping}",
            lambda spark, d, grouping=grouping: K.corpus_statistics(
                table(spark, d, "documents"), "text", ["lang", "source"], grouping
            ).withColumns({c: F.round(c, 6) for c in ("avg_word_length", "avg_sentence_length")}),
            f"SELECT lang, source, {columns} FROM {stats_sql} {clause}",
        )
    add(
        "A07_ngrams",
        lambda spark, d: table(spark, d, "documents").select(
            "doc_id", F.posexplode(X.ngrams(X.tokenize_words(F.col("text")), 3)).alias("pos", "gram")
        ).select("doc_id", "pos", F.array_join("gram", " ").alias("ngram")),
        f"""WITH w AS (SELECT doc_id, {words_sql(t)} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
            SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS ngram FROM i""",
    )
    add(
        "A07_conversation_ngrams",
        lambda spark, d: K.sequence_ngrams(table(spark, d, "conversations"), "conv_id", "turn", "text", 2, chunk=2),
        f"""WITH w AS (SELECT conv_id, turn, unnest({words_sql(t)}) AS w, generate_subscripts({words_sql(t)}, 1) AS i FROM conversations),
            n AS (SELECT conv_id, w, lead(w) OVER (PARTITION BY conv_id ORDER BY turn, i) AS nx FROM w)
            SELECT conv_id, w || ' ' || nx AS ngram, count(*) AS "count" FROM n WHERE nx IS NOT NULL GROUP BY 1, 2""",
    )
    add(
        "A08_top_ngrams",
        lambda spark, d: K.top_ngrams(table(spark, d, "documents"), "text", 2, 40),
        f"""WITH w AS (SELECT doc_id, unnest({words_sql(t)}) AS w, generate_subscripts({words_sql(t)}, 1) AS i FROM documents),
            n AS (SELECT w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS ngram FROM w)
            SELECT ngram, count(*) AS "count" FROM n WHERE ngram IS NOT NULL GROUP BY ngram ORDER BY 2 DESC, ngram LIMIT 40""",
    )
    add(
        "A09_distinct_words_by_language",
        lambda spark, d: K.word_frequency(table(spark, d, "documents"), "text", "lang").groupBy("lang").agg(F.count(F.lit(1)).alias("words")),
        f"SELECT lang, count(DISTINCT word) AS words FROM ({exploded}) GROUP BY lang",
    )
    add(
        "A10_sorted_languages",
        lambda spark, d: table(spark, d, "documents").select("lang").distinct().orderBy("lang"),
        "SELECT DISTINCT lang FROM documents ORDER BY lang",
    )

    # --- files, paths, sinks ---------------------------------------------------------
    files_sql = "SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.txt' AS path, CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END AS text FROM documents"

    def document_files(spark, d):
        """Every document as a file of its source and language, some of them empty."""
        path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))
        text = F.when(F.col("doc_id") % 50 == 7, "").otherwise(F.col("text"))
        return table(spark, d, "documents").select(
            path.alias("path"), text.alias("text"), text.cast("binary").alias("content"), F.octet_length(text).cast("long").alias("length"),
            F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
        )

    add(
        "F1_F2_hashes",
        lambda spark, d: S.inventory(document_files(spark, d)).select("file_path", "file_size", "sha256", "md5", "extension", "is_empty"),
        f"""SELECT path AS file_path, octet_length(encode(text)) AS file_size, sha256(text) AS sha256, md5(text) AS md5, '.txt' AS extension,
            octet_length(encode(text)) = 0 AS is_empty FROM ({files_sql})""",
    )
    add(
        "F3_byte_entropy",
        lambda spark, d: table(spark, d, "pages").select("page_id", F.round(S.byte_entropy(F.col("html").cast("binary")), 6).alias("entropy")),
        """WITH h AS (SELECT page_id, hex(encode(html)) AS h FROM pages), b AS (SELECT page_id, unnest(list_transform(range(0, length(h) // 2), lambda i: substr(h, CAST(i * 2 + 1 AS BIGINT), 2))) AS b FROM h),
           n AS (SELECT page_id, b, count(*) AS k FROM b GROUP BY 1, 2), t AS (SELECT page_id, k, sum(k) OVER (PARTITION BY page_id) AS total FROM n)
           SELECT page_id, round(-sum(k / total * log2(k / total)), 6) AS entropy FROM t GROUP BY page_id""",
    )
    add(
        "F4_readable_strings",
        lambda spark, d: table(spark, d, "pages").select(
            "page_id",
            F.translate(
                F.array_join(
                    S.readable_strings(F.concat(F.col("html").cast("binary"), F.lit(b"\x01"), F.encode(F.concat(F.lit("Wide "), "page_id"), "UTF-16LE")), None), "|"
                ),
                "\0", "",
            ).alias("strings"),
        ),
        "SELECT page_id, array_to_string(list_append(regexp_extract_all(html, '[ -~]{4,}'), 'Wide ' || page_id), '|') AS strings FROM pages",
    )
    add(
        "F5_embedded_urls",
        lambda spark, d: table(spark, d, "pages").select(
            "page_id", F.explode(S.embedded_urls(F.concat("html", F.lit(" "), "url"))).alias("url")
        ),
        "SELECT page_id, unnest(regexp_extract_all(html || ' ' || url, 'https?://[^\\s]+')) AS url FROM pages",
    )
    add(
        "F6_magic_number",
        lambda spark, d: table(spark, d, "pages").select("page_id", S.magic_number(F.col("html").cast("binary")).alias("magic")),
        "SELECT page_id, lower(substr(hex(encode(html)), 1, 8)) AS magic FROM pages",
    )

    def on_paths(name, function, sql):
        add(
            name,
            lambda spark, d: order_values(spark, d, "path").select("id", function(F.col("value")).alias("result")),
            f"SELECT id, {sql} AS result FROM {order_values_sql('path')}",
        )

    on_paths("F12_is_valid_path_pattern", X.is_valid_path_pattern, """regexp_matches(value, '^(\\.?/|[a-zA-Z]:/|/)[^:*?"<>|\\r\\n]+')""")
    on_paths(
        "F13_guess_os_from_path", X.guess_os_from_path,
        "CASE WHEN regexp_matches(value, '^[a-zA-Z]:\\\\') THEN 'Windows' WHEN regexp_matches(value, '^[/~]') THEN 'Unix' ELSE 'Unknown' END",
    )
    on_paths("F14_is_absolute_path", X.is_absolute_path, "starts_with(value, '/')")
    on_paths(
        "F15_normalize_path", X.normalize_path,
        """CASE o_mod WHEN 0 THEN '/srv/data/' || id WHEN 1 THEN value WHEN 2 THEN rtrim(value, '/') WHEN 3 THEN '//net'
           WHEN 4 THEN '../..' WHEN 6 THEN substr(value, 3) ELSE value END""",
    )
    run, sql = out["F15_normalize_path"]
    out["F15_normalize_path"] = (run, sql.replace("o_mod", "id % 8"))
    add(
        "SNK4_table_to_markdown",
        lambda spark, d: table(spark, d, "customer").selectExpr(
            "c_custkey AS id", "array(array('key', 'name', 'segment'), array(cast(c_custkey as string), c_name, c_mktsegment)) AS rows"
        ).select("id", sinks.table_to_markdown(F.col("rows")).alias("markdown"), sinks.table_to_markdown(F.col("rows"), gfm=True).alias("gfm")),
        """SELECT c_custkey AS id, '| key | name | segment |' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |' || chr(10) || '|---|---|---|' || chr(10) AS markdown,
           '| key | name | segment |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || c_custkey || ' | ' || c_name || ' | ' || c_mktsegment || ' |' || chr(10) AS gfm FROM customer""",
    )
    add(
        "SNK1_fenced_blocks",
        lambda spark, d: sinks.fenced_blocks(
            table(spark, d, "documents").select(
                F.concat(F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path"), "text"
            )
        ),
        """SELECT path, '## File: ' || path || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) AS block
           FROM (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, text FROM documents)""",
    )
    placed = """placed AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, path, '## File: ' || path || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || chr(10) AS block
      FROM files WHERE text <> '')"""
    for name, by in (("SNK1_concatenate", ""), ("SNK1_concatenate_by_directory", "directory, ")):
        add(
            name,
            lambda spark, d, by=by: sinks.concatenate(document_files(spark, d).select("path", "text"), 50_000, per_directory=bool(by)),
            f"""WITH files AS ({files_sql}), {placed},
                offs AS (SELECT *, CAST(sum(length(block)) OVER ({"PARTITION BY directory" if by else ""} ORDER BY path ROWS UNBOUNDED PRECEDING) - length(block) AS BIGINT) AS offset_ FROM placed)
                SELECT {by}offset_ // 50000 AS part, min(offset_) AS "offset", string_agg(block, '' ORDER BY path) AS content FROM offs GROUP BY {by}part""",
        )
    add(
        "CNV1_json_to_csv",
        lambda spark, d: table(spark, d, "events").select(
            "event_id", sinks.convert_column(F.col("props"), "json", "csv", "k INT").alias("csv"),
            F.to_json(F.struct("event_id", "event_type")).alias("json"),
        ),
        """SELECT event_id, json_extract_string(props, '$.k') AS csv, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json FROM events""",
    )

    kinds = {
        ".html": "text/html", ".TXT": "text/plain", ".json": "application/json", "": "text/plain", ".png": "image/png", ".zip": "application/zip",
        ".mp3": "audio/mpeg", ".mp4": "video/mp4", ".pdf": "application/pdf", ".py": "text/x-python", ".csv": "text/csv", ".xml": "text/xml",
    }
    cases = [f"WHEN {i} THEN '{{}}'" for i in range(len(kinds))]
    named = f"'page' || cast(page_id as string) || CASE page_id % {len(kinds)} " + " ".join(c.format(e) for c, e in zip(cases, kinds, strict=True)) + " END"
    mime = f"CASE page_id % {len(kinds)} " + " ".join(c.format(m) for c, m in zip(cases, kinds.values(), strict=True)) + " END"

    def typed_pages(spark, d):
        pages = table(spark, d, "pages").selectExpr("page_id", f"{named} AS path", "cast(html as binary) AS content")
        return pages.select(
            "page_id", "path", S.mime_type(F.col("path"), F.col("content")).alias("mime"),
            S.magic_type(F.col("content")).alias("magic"),
        )

    add(
        "F8_F9_file_types",
        lambda spark, d: typed_pages(spark, d).select(
            "page_id", "mime", *[f.alias(n) for n, f in S.file_flags(F.col("mime")).items()]
        ),
        f"""SELECT page_id, mime, starts_with(mime, 'text/') AS is_text, mime = 'image/png' AS is_image, mime = 'audio/mpeg' AS is_audio, mime = 'video/mp4' AS is_video,
            mime = 'application/pdf' AS is_pdf, mime = 'application/zip' AS is_archive, false AS is_executable, mime = 'text/csv' AS is_spreadsheet, mime = 'text/x-python' AS is_script
            FROM (SELECT page_id, {mime} AS mime FROM pages)""",
    )
    add(
        "F11_validate_file",
        lambda spark, d: typed_pages(spark, d).select(
            "page_id", F.inline(S.mismatches(F.col("path"), F.col("mime"), F.col("magic")))
        ),
        f"""SELECT page_id, 'MIME vs Content' AS type, mime AS expected, 'text/plain' AS actual
            FROM (SELECT page_id, {mime} AS mime FROM pages) WHERE mime <> 'text/plain'
            UNION ALL SELECT page_id, 'Extension vs MIME type', 'application/xml', mime FROM (SELECT page_id, {mime} AS mime FROM pages) WHERE mime = 'text/xml'""",
    )

    # --- model -----------------------------------------------------------------------
    add(
        "M4_character_counts",
        lambda spark, d: table(spark, d, "documents").withColumn("counts", M.character_counts(F.col("text"))).select(
            "doc_id", *[F.col("counts")[i].alias(n) for i, n in enumerate(("digits", "letters", "spaces", "others"))]
        ),
        """SELECT doc_id, CAST(len(regexp_extract_all(text, '\\d')) AS INTEGER) AS digits, CAST(len(regexp_extract_all(text, '\\p{L}')) AS INTEGER) AS letters,
           CAST(len(regexp_extract_all(text, '\\s')) AS INTEGER) AS spaces, CAST(length(text) - len(regexp_extract_all(text, '[\\p{L}\\p{N}\\s]')) AS INTEGER) AS others FROM documents""",
    )
    add(
        "M2_gram_weights",
        lambda spark, d: M.gram_table(table(spark, d, "part"), "p_name").withColumn("idf", F.round("idf", 6)),
        """WITH g AS (SELECT p_partkey, unnest(list_transform(range(1, length(p_name) - k + 2), lambda i: substr(lower(p_name), i, k))) AS gram
             FROM part, range(1, 6) AS s(k) WHERE length(p_name) >= k)
           SELECT gram, count(*) AS occurrences, count(DISTINCT p_partkey) AS documents,
             round(ln((1 + (SELECT count(*) FROM part)) / (1 + count(DISTINCT p_partkey))) + 1, 6) AS idf FROM g GROUP BY gram""",
    )
    def gram_vectors(spark, d):
        names = table(spark, d, "part").select("p_partkey", "p_name")
        found = M.vectors(names, "p_name", M.vocabulary(names, "p_name"))
        pairs = F.arrays_zip("indices", "values")
        return found.select("p_partkey", F.inline(pairs)).select("p_partkey", F.col("indices").alias("index"), F.round("values", 6).alias("value"))

    add(
        "M2_gram_vectors",
        gram_vectors,
        """WITH g AS (SELECT p_partkey, unnest(list_transform(range(1, length(p_name) - k + 2), lambda i: substr(lower(p_name), i, k))) AS gram
             FROM part, range(1, 6) AS s(k) WHERE length(p_name) >= k),
           w AS (SELECT gram, ln((1 + (SELECT count(*) FROM part)) / (1 + count(DISTINCT p_partkey))) + 1 AS idf, row_number() OVER (ORDER BY gram) - 1 AS i FROM g GROUP BY gram),
           t AS (SELECT p_partkey, i, count(*) * any_value(idf) AS v FROM g JOIN w USING (gram) GROUP BY p_partkey, i),
           c AS (SELECT p_partkey, unnest(string_split(p_name, '')) || '_pos_' || (generate_subscripts(string_split(p_name, ''), 1) - 1) AS feature FROM part),
           p AS (SELECT feature, (SELECT count(*) FROM w) + row_number() OVER (ORDER BY feature) - 1 AS i FROM c GROUP BY feature)
           SELECT p_partkey, CAST(i AS INTEGER) AS index, round(v / sqrt(sum(v * v) OVER (PARTITION BY p_partkey)), 6) AS value FROM t
           UNION ALL SELECT p_partkey, CAST(i AS INTEGER), 1.0 FROM c JOIN p USING (feature)""",
    )
    add(
        "M3_position_counts",
        lambda spark, d: M.position_table(table(spark, d, "part"), "p_name"),
        """SELECT c || '_pos_' || i AS feature, count(*) AS occurrences FROM (
             SELECT unnest(string_split(p_name, '')) AS c, generate_subscripts(string_split(p_name, ''), 1) - 1 AS i FROM part) GROUP BY 1""",
    )
    predicted = "CASE WHEN quality + toxic > 0 THEN 1 ELSE 0 END"
    add(
        "M6_classification_report",
        lambda spark, d: M.classification_report(
            table(spark, d, "labels").selectExpr("quality AS label", f"{predicted} AS prediction")
        ).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")}),
        f"""WITH p AS (SELECT quality AS l, {predicted} AS p FROM labels), c AS (SELECT DISTINCT l AS label FROM p UNION SELECT DISTINCT p FROM p),
            s AS (SELECT label, (SELECT count(*) FROM p WHERE l = label AND p = label) AS h, (SELECT count(*) FROM p WHERE p = label) AS pr, (SELECT count(*) FROM p WHERE l = label) AS su FROM c)
            SELECT label, round(CASE WHEN pr > 0 THEN h / pr ELSE 0 END, 6) AS precision, round(CASE WHEN su > 0 THEN h / su ELSE 0 END, 6) AS recall,
            round(2 * h / (su + pr), 6) AS f1, su AS support FROM s""",
    )
    add(
        "M2_M5_classifier",
        # which column a value comes from, told by its characters
        lambda spark, d: M.classification_report(
            M.train_and_predict(
                table(spark, d, "part").selectExpr("stack(3, p_name, 'name', p_brand, 'brand', p_type, 'type') AS (text, label)")
            )
        ),
    )
    return out
