"""The same queries as SQL for an independent engine, over the same tables.

Each oracle is a chain of common table expressions; `_sql` strings the needed ones together.
"""

from __future__ import annotations

from storyrank.config import (
    CleanConfig,
    ClusterConfig,
    PhraseConfig,
    RankConfig,
    TfIdfConfig,
    TopicConfig,
    WordVectorConfig,
)

_WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _plain_words(post: str) -> str:
    kept = (
        f"list_filter(string_split_regex(lower({post}), '{_WHITESPACE}'), lambda t: t <> '' "
        "AND NOT starts_with(t, '@') AND NOT starts_with(t, '#') "
        "AND NOT starts_with(t, 'http') AND t <> 'rt')"
    )
    return (
        f"list_filter(string_split_regex(array_to_string({kept}, ' '), '[^a-zA-Z]+'), "
        "lambda w: w <> '')"
    )


def _content_words(post: str) -> str:
    cfg = CleanConfig()
    return (
        f"list_filter({_plain_words(post)}, lambda w: length(w) >= {cfg.min_word_length} "
        f"AND w NOT IN ({_quoted(cfg.stop_words)}))"
    )


_TF, _RANK, _TOPIC, _PHRASE = TfIdfConfig(), RankConfig(), TopicConfig(), PhraseConfig()
_WORD, _CLUSTER = WordVectorConfig(), ClusterConfig()

_MARKED = (
    "concat('RT @user', doc_id, ': ', text, ' #tag', doc_id % 7, ' https://t.co/', doc_id)"
)

_PARTS: dict[str, str] = {
    "posts": "SELECT CAST(doc_id AS VARCHAR) AS id_str, text AS tweet, doc_id AS seq, source, lang "
    "FROM documents",
    "decorated": f"SELECT CAST(doc_id AS VARCHAR) AS id_str, {_MARKED} AS tweet FROM documents",
    "decorated_words": f"SELECT id_str, {_content_words('tweet')} AS words FROM decorated",
    "news": "SELECT p.*, strftime(e.ts, '%a %b %d %H:%M:%S +0000 %Y') AS ctime, e.ts, "
    "CAST(floor(e.value) AS INTEGER) AS rt_cnt, e.event_type "
    "FROM posts p JOIN events e ON p.seq = e.event_id",
    "cleaned": f"SELECT id_str, seq, source, array_to_string({_content_words('tweet')}, ' ') AS clean "
    "FROM posts",
    "corpus": "SELECT clean, arg_min(id_str, seq) AS id_str, min(seq) AS seq, "
    "arg_min(source, seq) AS source FROM cleaned GROUP BY clean",
    "words": "SELECT id_str, unnest(list_filter(string_split(clean, ' '), lambda w: w <> '')) AS word "
    "FROM corpus",
    "doc_terms": f"SELECT id_str, word AS term, count(*) AS tf FROM words "
    f"WHERE word NOT IN ({_quoted(_TF.stop_words)}) GROUP BY id_str, word",
    "terms": "SELECT term, count(*) AS df, "
    "ln((1.0 + (SELECT count(*) FROM corpus)) / (1.0 + count(*))) + 1.0 AS idf "
    f"FROM doc_terms GROUP BY term HAVING count(*) >= {_TF.min_df} "
    f"AND count(*) <= {_TF.max_df} * (SELECT count(*) FROM corpus)",
    "weights": "SELECT id_str, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY id_str)) "
    "AS weight FROM doc_terms JOIN terms USING (term)",
    "counted": "SELECT id_str, word AS term, count(*) AS tf FROM words GROUP BY id_str, word",
    # phrases
    "split": "SELECT id_str, string_split(clean, ' ') AS w FROM corpus",
    "placed": "SELECT id_str, generate_subscripts(w, 1) AS pos, unnest(w) AS a FROM split",
    "following": "SELECT id_str, pos, a, lead(a) OVER (PARTITION BY id_str ORDER BY pos) AS b FROM placed",
    "singles": "SELECT a, count(*) AS n FROM following GROUP BY a",
    "pairs": "SELECT a, b, count(*) AS n FROM following WHERE b IS NOT NULL GROUP BY a, b",
    "scored_pairs": f"SELECT p.a, p.b, p.n, (p.n - {_PHRASE.min_count}) * "
    "((SELECT count(*) FROM singles) + (SELECT count(*) FROM pairs))::DOUBLE / (x.n * y.n) AS score "
    "FROM pairs p JOIN singles x ON p.a = x.a JOIN singles y ON p.b = y.a "
    f"WHERE p.n >= {_PHRASE.min_count}",
    "phrases": f"SELECT * FROM scored_pairs WHERE score > {_PHRASE.threshold}",
    "marked": "SELECT f.id_str, f.pos, f.a, f.b, p.a IS NOT NULL AS hit "
    "FROM following f LEFT JOIN phrases p ON f.a = p.a AND f.b = p.b WHERE f.a <> ''",
    "islands": "SELECT *, pos - row_number() OVER (PARTITION BY id_str, hit ORDER BY pos) AS island "
    "FROM marked",
    "offsets": "SELECT *, hit AND (row_number() OVER (PARTITION BY id_str, hit, island ORDER BY pos)) "
    "% 2 = 1 AS taken FROM islands",
    "reading": "SELECT *, coalesce(lag(taken) OVER (PARTITION BY id_str ORDER BY pos), false) AS used "
    "FROM offsets",
    "merged": "SELECT id_str, pos, CASE WHEN taken THEN a || '_' || b ELSE a END AS w "
    "FROM reading WHERE NOT used",
    # pairs of words within a window
    "known": "SELECT a AS word, n, least(1.0, sqrt(r) + r) AS share FROM "
    f"(SELECT a, n, {_WORD.sample} * sum(n) OVER () / n AS r FROM (SELECT a, count(*) AS n FROM placed "
    f"WHERE a <> '' GROUP BY a HAVING count(*) >= {_WORD.min_count}))",
    "near": "SELECT x.a, y.a AS b FROM placed x JOIN placed y ON x.id_str = y.id_str "
    f"AND x.pos <> y.pos AND abs(x.pos - y.pos) <= {_WORD.window} WHERE x.a <> '' AND y.a <> ''",
    "near_weights": "SELECT p.a, p.b, p.n * k.share * l.share AS w FROM "
    "(SELECT a, b, count(*) AS n FROM near GROUP BY a, b) p "
    "JOIN known k ON p.a = k.word JOIN known l ON p.b = l.word",
    "near_sums": "SELECT a, sum(w) AS s FROM near_weights GROUP BY a",
    "ppmi": "SELECT w.a, w.b, ln(w.w * (SELECT sum(s) FROM near_sums) / (x.s * y.s)) "
    f"- ln({_WORD.negatives}) AS value FROM near_weights w "
    "JOIN near_sums x ON w.a = x.a JOIN near_sums y ON w.b = y.a",
    # vectors with given labels
    "dims": "SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, "
    "unnest(embedding)::DOUBLE AS v FROM embeddings",
    "centres": "SELECT label, i, avg(v) AS c FROM dims GROUP BY label, i",
    "every_dist": "SELECT d.vec_id, c.label AS cluster, sqrt(sum((d.v - c.c) ** 2)) AS dist "
    "FROM dims d JOIN centres c ON d.i = c.i GROUP BY d.vec_id, c.label",
    "own_dist": "SELECT e.vec_id, e.cluster, e.dist FROM every_dist e "
    "JOIN embeddings m ON e.vec_id = m.vec_id AND e.cluster = m.label",
    # ranking with the source as cluster
    "labels_by_source": "SELECT c.id_str, c.seq, c.clean, c.source AS cluster, n.rt_cnt "
    "FROM corpus c JOIN news n ON c.id_str = n.id_str",
    "sizes": "SELECT cluster, count(*) AS n FROM labels_by_source GROUP BY cluster",
    "term_centres": "SELECT cluster, term, sum(weight) / any_value(n) AS c "
    "FROM weights JOIN labels_by_source USING (id_str) JOIN sizes USING (cluster) GROUP BY cluster, term",
    "lengths": "SELECT cluster, sum(c * c) AS cc FROM term_centres GROUP BY cluster",
    "inner_products": "SELECT id_str, sum(weight * weight) AS xx, sum(weight * c) AS xc "
    "FROM weights JOIN labels_by_source USING (id_str) JOIN term_centres USING (cluster, term) "
    "GROUP BY id_str",
    "members": "SELECT l.*, sqrt(greatest(coalesce(xx, 0) + coalesce(cc, 0) - 2 * coalesce(xc, 0), 0)) "
    "AS dist FROM labels_by_source l LEFT JOIN lengths USING (cluster) "
    "LEFT JOIN inner_products USING (id_str)",
    "tagged": "SELECT term, idf, CASE WHEN term LIKE '%ing' THEN 'VBG' WHEN term LIKE '%ed' THEN 'VBD' "
    "WHEN term LIKE '%ly' THEN 'RB' WHEN term LIKE '%able' THEN 'JJ' "
    f"ELSE '{_RANK.default_tag}' END AS tag FROM terms",
    "kept": f"SELECT term, idf FROM tagged WHERE tag IN ({_quoted(_RANK.tags)})",
    "scores": "SELECT w.id_str, sum(coalesce(k.idf, 0)) / count(*) AS score "
    "FROM words w LEFT JOIN kept k ON w.word = k.term GROUP BY w.id_str",
    "far": "SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY "
    f"round(dist, {_RANK.distance_digits}) DESC, seq) AS dist_rank FROM members",
    "best": "SELECT f.cluster, f.id_str, f.dist_rank, s.score, row_number() OVER (PARTITION BY f.cluster "
    "ORDER BY round(s.score, 9) DESC, f.dist_rank) AS place "
    f"FROM far f JOIN scores s USING (id_str) WHERE f.dist_rank <= {_RANK.candidates}",
    "events_by_source": "SELECT cluster, sum(rt_cnt) AS rt_sum FROM labels_by_source GROUP BY cluster "
    f"ORDER BY rt_sum DESC, cluster LIMIT {_RANK.events}",
    # lexicons made from the vocabulary by rule
    "raw_vocabulary": "SELECT DISTINCT unnest(words) AS token FROM decorated_words",
    "nouns": "SELECT token, regexp_replace(token, 's$', '') AS lemma FROM raw_vocabulary "
    "WHERE token LIKE '%s'",
    "verbs": "SELECT token, regexp_replace(token, '(ing|ed)$', '') AS lemma FROM raw_vocabulary "
    "WHERE regexp_matches(token, '(ing|ed)$')",
    "stems": "SELECT token, regexp_replace(token, '(ment|tion|ly)$', '') AS stem FROM raw_vocabulary "
    "WHERE regexp_matches(token, '(ment|tion|ly)$')",
    "raw_placed": "SELECT id_str, generate_subscripts(words, 1) AS pos, unnest(words) AS token "
    "FROM decorated_words",
    "nouned": "SELECT id_str, pos, coalesce(lemma, p.token) AS token FROM raw_placed p "
    "LEFT JOIN nouns n ON p.token = n.token",
    "lemmatised": "SELECT id_str, pos, coalesce(lemma, p.token) AS token FROM nouned p "
    "LEFT JOIN verbs v ON p.token = v.token",
    "stemmed": "SELECT id_str, pos, coalesce(stem, p.token) AS token FROM raw_placed p "
    "LEFT JOIN stems s ON p.token = s.token",
}

_NEEDS: dict[str, tuple[str, ...]] = {
    "decorated_words": ("decorated",),
    "news": ("posts",),
    "cleaned": ("posts",),
    "corpus": ("cleaned",),
    "words": ("corpus",),
    "doc_terms": ("words",),
    "terms": ("doc_terms",),
    "weights": ("terms",),
    "counted": ("words",),
    "split": ("corpus",),
    "placed": ("split",),
    "following": ("placed",),
    "singles": ("following",),
    "pairs": ("following",),
    "scored_pairs": ("singles", "pairs"),
    "phrases": ("scored_pairs",),
    "marked": ("phrases",),
    "islands": ("marked",),
    "offsets": ("islands",),
    "reading": ("offsets",),
    "merged": ("reading",),
    "known": ("placed",),
    "near": ("placed",),
    "near_weights": ("known", "near"),
    "near_sums": ("near_weights",),
    "ppmi": ("near_sums",),
    "centres": ("dims",),
    "every_dist": ("centres",),
    "own_dist": ("every_dist",),
    "labels_by_source": ("corpus", "news"),
    "sizes": ("labels_by_source",),
    "term_centres": ("weights", "sizes"),
    "lengths": ("term_centres",),
    "inner_products": ("term_centres",),
    "members": ("lengths", "inner_products"),
    "tagged": ("terms",),
    "kept": ("tagged",),
    "scores": ("kept",),
    "far": ("members",),
    "best": ("far", "scores"),
    "events_by_source": ("labels_by_source",),
    "raw_vocabulary": ("decorated_words",),
    "nouns": ("raw_vocabulary",),
    "verbs": ("raw_vocabulary",),
    "stems": ("raw_vocabulary",),
    "raw_placed": ("decorated_words",),
    "nouned": ("nouns", "raw_placed"),
    "lemmatised": ("nouned", "verbs"),
    "stemmed": ("stems", "raw_placed"),
}


def _sql(final: str, *parts: str) -> str:
    ordered: list[str] = []

    def need(part: str) -> None:
        if part not in ordered:
            for earlier in _NEEDS.get(part, ()):
                need(earlier)
            ordered.append(part)

    for part in parts:
        need(part)
    if not ordered:
        return final
    chain = ",\n".join(f"{p} AS MATERIALIZED ({_PARTS[p]})" for p in ordered)
    return f"WITH {chain}\n{final}"


def _rebuilt(source: str) -> str:
    """Clean text from mapped words, the length filter applied again; empty posts stay."""
    return (
        "SELECT d.id_str, coalesce(string_agg(m.token, ' ' ORDER BY m.pos), '') AS clean "
        f"FROM decorated_words d LEFT JOIN (SELECT * FROM {source} "
        f"WHERE length(token) >= {CleanConfig().min_word_length}) m ON d.id_str = m.id_str "
        "GROUP BY d.id_str"
    )


def _counts() -> str:
    rows = {
        "posts": "count(*) FROM posts",
        "cleaned_posts": "count(clean) FROM cleaned",
        "distinct_texts": "count(*) FROM corpus",
        "empty_texts": "count(*) FROM corpus WHERE clean = ''",
        "distinct_words": "count(DISTINCT word) FROM words",
        "vocabulary_min_count_4": "count(*) FROM "
        "(SELECT word FROM words GROUP BY word HAVING count(*) >= 4)",
        "tokens_after_phrases": "count(*) FROM merged",
    }
    return " UNION ALL ".join(f"SELECT '{k}' AS metric, {_as_value(v)}" for k, v in rows.items())


def _as_value(expression: str) -> str:
    head, rest = expression.split(" FROM ", 1)
    return f"CAST({head} AS BIGINT) AS value FROM {rest}"


def _thirty(direction: str) -> str:
    return (
        "SELECT cluster, vec_id, CAST(dist_rank AS INTEGER) AS dist_rank, "
        "printf('%.3f', dist) AS dist FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY cluster ORDER BY round(dist, {_RANK.distance_digits}) {direction}, vec_id) "
        f"AS dist_rank FROM own_dist) WHERE dist_rank <= {_RANK.candidates}"
    )


_ASCII_LINE = (
    "concat_ws(', ', regexp_replace(n.tweet, '[^\\x00-\\x7F]', '', 'g'), n.ctime, "
    "CAST(n.rt_cnt AS VARCHAR))"
)

# posts with the noun pass, then the verb pass over their own vocabulary
_LEMMATISED = (
    f"WITH w AS (SELECT id_str, seq, source, {_content_words('tweet')} AS words FROM posts), "
    "p AS (SELECT id_str, generate_subscripts(words, 1) AS pos, unnest(words) AS token FROM w), "
    "v AS (SELECT DISTINCT token FROM p), "
    "n AS (SELECT id_str, pos, regexp_replace(token, 's$', '') AS token FROM p), "
    "l AS (SELECT n.id_str, n.pos, CASE WHEN v.token IS NULL THEN n.token "
    "ELSE regexp_replace(n.token, '(ing|ed)$', '') END AS token FROM n LEFT JOIN v ON n.token = v.token) "
    "SELECT w.id_str, w.seq, w.source, coalesce(string_agg(l.token, ' ' ORDER BY l.pos), '') AS clean "
    f"FROM w LEFT JOIN (SELECT * FROM l WHERE length(token) >= {CleanConfig().min_word_length}) l "
    "ON w.id_str = l.id_str GROUP BY w.id_str, w.seq, w.source"
)

# conversation turns in the shape of posts
_TURNS = (
    "SELECT conv_id || '-' || turn AS id_str, text AS tweet, "
    "row_number() OVER (ORDER BY conv_id, turn) AS seq, '' AS source, '' AS lang FROM conversations"
)

_GOOD = "event_type NOT IN ('error', 'signup')"

# English posts came first with their own counts, all others with one more.
_UPSERTED = (
    "SELECT id_str, tweet, ctime, "
    "CAST(CASE WHEN lang = 'en' THEN rt_cnt ELSE rt_cnt + 1 END AS INTEGER) AS rt_cnt "
    f"FROM news WHERE {_GOOD}"
)

ORACLES: dict[str, str] = {
    "clean_corpus": _sql(
        "SELECT id_str, array_to_string(words, ' ') AS clean FROM decorated_words", "decorated_words"
    ),
    "clean_corpus_plain": _sql(
        f"SELECT id_str, array_to_string({_plain_words('tweet')}, ' ') AS clean FROM decorated",
        "decorated",
    ),
    "clean_corpus_lemma": _sql(_rebuilt("lemmatised"), "lemmatised"),
    "clean_corpus_stem": _sql(_rebuilt("stemmed"), "stemmed"),
    "dedup_corpus": _sql("SELECT id_str, clean FROM corpus", "corpus"),
    "corpus_counts": _sql(_counts(), "words", "merged"),
    "vocabulary_min_count": _sql(
        "SELECT word, count(*) AS count FROM words GROUP BY word HAVING count(*) >= 4", "words"
    ),
    "status_parse": _sql(
        f"SELECT CASE WHEN {_GOOD} THEN id_str END AS id_str, CASE WHEN {_GOOD} THEN tweet END AS tweet, "
        f"CASE WHEN {_GOOD} THEN ctime END AS ctime, CASE WHEN {_GOOD} THEN rt_cnt END AS rt_cnt, "
        "CASE event_type WHEN 'error' THEN 'not a JSON object' WHEN 'signup' THEN 'not a status' "
        "ELSE 'accepted' END AS outcome FROM news",
        "news",
    ),
    "news_upsert": _sql(_UPSERTED, "news"),
    "news_upsert_moved_day": _sql(
        _UPSERTED.replace(
            "tweet, ctime,",
            "tweet, CASE WHEN lang = 'en' THEN ctime WHEN seq % 2 = 0 THEN 'no time' "
            "ELSE 'Sun Jan 01 00:00:00 +0000 2017' END AS ctime,",
        ),
        "news",
    ),
    "stream_ingest": _sql(_UPSERTED, "news"),
    "news_view": _sql(
        "SELECT id_str, tweet, ctime, rt_cnt, CAST(floor(epoch(ts)) AS BIGINT) AS created_epoch FROM news",
        "news",
    ),
    "idf_terms": _sql("SELECT term, df, round(idf, 6) AS idf FROM terms", "terms"),
    "tfidf_long": _sql("SELECT id_str, term, round(weight, 6) AS weight FROM weights", "weights"),
    "term_counts_500": _sql(
        "SELECT id_str, term, CAST(tf AS INTEGER) AS tf FROM counted SEMI JOIN "
        "(SELECT term FROM counted GROUP BY term "
        f"HAVING count(*) >= {_TOPIC.min_df} ORDER BY sum(tf) DESC, term LIMIT {_TOPIC.max_features}) "
        "USING (term)",
        "counted",
    ),
    "phrase_scores": _sql("SELECT a, b, n, round(score, 4) AS score FROM phrases", "phrases"),
    "phrase_merge": _sql(
        "SELECT c.id_str, coalesce(string_agg(w, ' ' ORDER BY pos), '') AS phrased "
        "FROM corpus c LEFT JOIN merged m ON c.id_str = m.id_str GROUP BY c.id_str", "merged"
    ),
    "cooccurrence_ppmi": _sql(
        "SELECT a, b, round(value, 4) AS value FROM ppmi WHERE round(value, 6) > 0", "ppmi"
    ),
    "centroid_distance": _sql(
        "SELECT vec_id, cluster, round(dist, 4) AS dist FROM own_dist", "own_dist"
    ),
    "all_centroid_distances": _sql(
        "SELECT vec_id, cluster, round(dist, 4) AS dist FROM every_dist", "every_dist"
    ),
    "farthest30": _sql(_thirty("DESC"), "own_dist"),
    "nearest30": _sql(_thirty("ASC"), "own_dist"),
    "cluster_members": _sql(
        "SELECT cluster, vec_id, printf('%.3f', dist) AS dist, n_members FROM own_dist JOIN "
        "(SELECT label AS cluster, count(*) AS n_members FROM embeddings GROUP BY label) USING (cluster)",
        "own_dist",
    ),
    "hot_clusters_top2": (
        "SELECT cluster, rt_sum, CAST(row_number() OVER (ORDER BY rt_sum DESC, cluster) AS INTEGER) "
        "AS event_rank FROM (SELECT label AS cluster, CAST(sum(floor(value)) AS BIGINT) AS rt_sum "
        "FROM embeddings JOIN events ON vec_id = event_id GROUP BY label "
        f"ORDER BY rt_sum DESC, cluster LIMIT {_RANK.events})"
    ),
    "turn_phrases": _sql("SELECT a, b, n, round(score, 4) AS score FROM phrases", "phrases").replace(
        f"({_PARTS['posts']})", f"({_TURNS})"
    ),
    "post_score": _sql("SELECT id_str, round(score, 6) AS score FROM scores", "scores"),
    "source_distance": _sql(
        "SELECT cluster, id_str, round(dist, 4) AS dist FROM members", "members"
    ),
    "cluster_winner": _sql(
        "SELECT cluster, id_str, CAST(dist_rank AS INTEGER) AS dist_rank, round(score, 6) AS score "
        "FROM best WHERE place = 1",
        "best",
    ),
    "hot_news_fixed": _sql(
        "SELECT CAST(row_number() OVER (ORDER BY e.rt_sum DESC, e.cluster) AS INTEGER) AS event_rank, "
        f"e.cluster, CAST(e.rt_sum AS BIGINT) AS rt_sum, b.id_str, n.rt_cnt, {_ASCII_LINE} AS line "
        "FROM events_by_source e JOIN best b ON e.cluster = b.cluster AND b.place = 1 "
        "JOIN news n ON b.id_str = n.id_str",
        "best",
        "events_by_source",
    ).replace(f"({_PARTS['cleaned']})", f"({_LEMMATISED})"),
    # model steps and invariants
    "kmeans_step": _sql(
        "SELECT cluster, CAST(i - 1 AS INTEGER) AS i, round(avg(v), 4) AS v FROM dims JOIN "
        "(SELECT vec_id, arg_min(cluster, dist) AS cluster FROM every_dist GROUP BY vec_id) USING (vec_id) "
        "GROUP BY cluster, i",
        "every_dist",
    ),
    "lsa_norms": _sql(
        "SELECT id_str, CASE WHEN w.id_str IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm "
        "FROM corpus LEFT JOIN (SELECT DISTINCT id_str FROM weights) w USING (id_str)",
        "weights",
    ),
    "kmeans_total": _sql(
        "SELECT count(*) AS posts, count(*) AS clustered, count(*) AS ids FROM corpus", "corpus"
    ),
    "cluster_term_ranks": (
        "SELECT CAST(c.range AS INTEGER) AS cluster, CAST(r.range AS INTEGER) AS rank "
        f"FROM range({_CLUSTER.k}) c, range(1, 11) r"
    ),
    "topic_docs": _sql(
        "SELECT DISTINCT id_str, 1.0::DOUBLE AS total FROM counted SEMI JOIN "
        "(SELECT term FROM counted GROUP BY term "
        f"HAVING count(*) >= {_TOPIC.min_df} ORDER BY sum(tf) DESC, term LIMIT {_TOPIC.max_features}) "
        "USING (term)",
        "counted",
    ),
    "topic_word_ranks": (
        "SELECT CAST(t.range AS INTEGER) AS topic, CAST(r.range AS INTEGER) AS rank "
        f"FROM range({_TOPIC.k}) t, range(1, {_TOPIC.words_per_topic + 1}) r"
    ),
    "vector_words": _sql(
        f"SELECT word, {_WORD.size} AS width FROM words GROUP BY word HAVING count(*) >= {_WORD.min_count}",
        "words",
    ),
}
