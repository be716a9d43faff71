"""Queries on cards, sessions, logs and streams (groups D, E, L and W)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectura import constants as K
from lectura.functions import srs
from lectura.operators import coverage as G
from lectura.operators import known as N
from lectura.operators import logs as L
from lectura.operators import sessions as E
from lectura.operators import srs as D
from lectura.operators import teach as C
from lectura.operators import vocab as V
from lectura.plans import stand_ins as S
from lectura.plans.ctes import ACTION_OF, GRADE_OF, TIME, case
from lectura.plans.registry import CTES, query
from lectura.plans.study_queries import Books, Study
from lectura.session import shared_folder
from lectura.streaming import streams as W

_DAY = 86_400_000_000


def _fsrs_columns(cards: DataFrame) -> DataFrame:
    f = F.col("fsrs")
    return cards.select(
        "user_id", "lemma_id", "created_at", f["due"].alias("due"), f["stability"].alias("stability"),
        f["difficulty"].alias("difficulty"), f["elapsed_days"].alias("elapsed_days"),
        f["scheduled_days"].alias("scheduled_days"), f["learning_steps"].alias("learning_steps"),
        f["reps"].alias("reps"), f["lapses"].alias("lapses"), f["state"].alias("state"), f["last_review"].alias("last_review"),
    )


# --- spaced repetition -------------------------------------------------------------------------

@query("d1_new_cards", f"""
    SELECT DISTINCT user_id, lemma_id, {TIME} AS created_at, {TIME} AS due, 0.0::DOUBLE AS stability, 0.0::DOUBLE AS difficulty, 0 AS elapsed_days,
           0 AS scheduled_days, 0 AS learning_steps, 0 AS reps, 0 AS lapses, 0 AS state, NULL::TIMESTAMP AS last_review FROM evk""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = S.named_events(spark, sf).select("user_id", "lemma_id").distinct()
    return _fsrs_columns(D.new_cards(pairs, S.now()))


@query("d2_grades", f"""
    SELECT event_type, g AS grade, CASE g WHEN 'again' THEN 1 WHEN 'hard' THEN 2 WHEN 'good' THEN 3 WHEN 'easy' THEN 4 ELSE 0 END AS number,
           coalesce(g IN ('good', 'easy'), false) AS passing, count(*) AS n FROM (SELECT event_type, {case('event_type', GRADE_OF)} AS g FROM ev) GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    graded = S.events(spark, sf).withColumn("grade", S.mapped("event_type", S.GRADE_OF))
    return graded.groupBy(
        "event_type", "grade", F.coalesce(srs.grade_number(F.col("grade")), F.lit(0)).alias("number"),
        F.coalesce(srs.is_passing(F.col("grade")), F.lit(False)).alias("passing"),
    ).agg(F.count(F.lit(1)).alias("n"))


# The published algorithm once more, one recursion step per answer.
w = K.FSRS_WEIGHTS
_D0 = [srs.initial_difficulty(g) for g in (1, 2, 3, 4)]
_r8 = lambda x: f"(floor(({x}) * 1e8 + 0.5) / 1e8)"
_SHORT = lambda g: (
    f"s * greatest(pow(s, {-w[19]}::DOUBLE) * exp({w[17]}::DOUBLE * ({g} - 3 + {w[18]}::DOUBLE)), 1.0)" if g >= 3
    else f"s * (pow(s, {-w[19]}::DOUBLE) * exp({w[17]}::DOUBLE * ({g} - 3 + {w[18]}::DOUBLE)))"
)
_LATER = {
    1: f"least({_r8(f's / exp({w[17]}::DOUBLE * {w[18]}::DOUBLE)')}, {w[11]}::DOUBLE * pow(d, {-w[12]}::DOUBLE) * (pow(s + 1, {w[13]}::DOUBLE) - 1) * exp({w[14]}::DOUBLE * (1 - rc)))",
    **{g: f"s * (1 + exp({w[8]}::DOUBLE) * (11 - d) * pow(s, {-w[9]}::DOUBLE) * (exp({w[10]}::DOUBLE * (1 - rc)) - 1) * {b}::DOUBLE)"
       for g, b in ((2, w[15]), (3, 1.0), (4, w[16]))},
}
_AFTER = {g: _r8(f"least(greatest(CASE WHEN t = 0 THEN {_SHORT(g)} ELSE {_LATER[g]} END, 0.001), 36500.0)") for g in (1, 2, 3, 4)}
_IV = lambda x: f"least(greatest(floor({x} + 0.5), 1), 36500)"
CTES["answers"] = f"""
    SELECT user_id, lemma_id, epoch_us(ts) AS us, g, row_number() OVER (PARTITION BY user_id, lemma_id ORDER BY ts, event_id) AS i
    FROM (SELECT *, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS g FROM evk) WHERE g IS NOT NULL"""
def _fold_sql(name: str, log: str, base: str) -> str:
    """Cards of ``base`` (i = 0) and their states after each answer of ``log``, one recursion step per answer."""
    return f"""
    {base}
    UNION ALL
    SELECT user_id, lemma_id, created, us + CASE WHEN mins > 0 THEN mins * 60000000 ELSE iv::BIGINT * {_DAY} END, ns, nd, t,
           CASE WHEN mins > 0 THEN 0 ELSE iv::BIGINT END, CASE WHEN mins > 0 AND g = 2 THEN step WHEN mins > 0 AND g = 3 THEN step + 1 ELSE 0 END,
           reps + 1, lapses + CASE WHEN state = 2 AND g = 1 THEN 1 ELSE 0 END,
           CASE WHEN mins = 0 THEN 2 WHEN state IN (0, 1) THEN 1 ELSE 3 END, us, i
    FROM (SELECT *, [s1, s2, s3, s4][g] AS ns,
             CASE WHEN state IN (0, 1) AND g = 1 THEN 1 WHEN state IN (0, 1) AND g = 2 THEN 6 WHEN state IN (0, 1) AND g = 3 AND step = 0 THEN 10
                  WHEN state IN (2, 3) AND g = 1 THEN 10 WHEN state = 3 AND g = 2 THEN 15 ELSE 0 END AS mins,
             CASE WHEN state = 2 AND g > 1 THEN
                CASE g WHEN 2 THEN least({_IV('s2')}, {_IV('s3')}) WHEN 3 THEN greatest({_IV('s3')}, least({_IV('s2')}, {_IV('s3')}) + 1)
                       ELSE greatest({_IV('s4')}, greatest({_IV('s3')}, least({_IV('s2')}, {_IV('s3')}) + 1) + 1) END
                ELSE {_IV('[s1, s2, s3, s4][g]')} END AS iv
          FROM (SELECT *, CASE WHEN state = 0 THEN {w[0]}::DOUBLE ELSE {_AFTER[1]} END AS s1, CASE WHEN state = 0 THEN {w[1]}::DOUBLE ELSE {_AFTER[2]} END AS s2,
                       CASE WHEN state = 0 THEN {w[2]}::DOUBLE ELSE {_AFTER[3]} END AS s3, CASE WHEN state = 0 THEN {w[3]}::DOUBLE ELSE {_AFTER[4]} END AS s4,
                       CASE WHEN state = 0 THEN [{', '.join(f'{x}::DOUBLE' for x in _D0)}][g]
                            ELSE {_r8(f"least(greatest({w[7]}::DOUBLE * {_D0[3]}::DOUBLE + (1 - {w[7]}::DOUBLE) * (d + ({-w[6]}::DOUBLE * (g - 3)) * (10 - d) / 9), 1.0), 10.0)")} END AS nd
                FROM (SELECT f.* EXCLUDE (i), a.us, a.g, a.i, CASE WHEN f.state = 0 THEN 0 ELSE a.us // {_DAY} - f.last // {_DAY} END AS t,
                             CASE WHEN f.state = 0 THEN 1.0 ELSE pow(1 + {srs.FACTOR!r}::DOUBLE * (a.us // {_DAY} - f.last // {_DAY}) / f.s, {srs.DECAY}::DOUBLE) END AS rc
                      FROM {name} f JOIN {log} a ON a.user_id = f.user_id AND a.lemma_id = f.lemma_id AND a.i = f.i + 1)))"""


_NEW_CARDS = """
    SELECT user_id, lemma_id, us AS created, us AS due, 0.0::DOUBLE AS s, 0.0::DOUBLE AS d, 0::BIGINT AS elapsed, 0::BIGINT AS scheduled,
           0 AS step, 0 AS reps, 0 AS lapses, 0 AS state, NULL::BIGINT AS last, 0::BIGINT AS i FROM answers WHERE i = 1"""
CTES["folded"] = _fold_sql("folded", "answers", _NEW_CARDS)
_REPLAYED = """
    SELECT user_id, lemma_id, make_timestamp(created) AS created_at, make_timestamp(due) AS due, s AS stability, d AS difficulty, elapsed::INTEGER AS elapsed_days,
           scheduled::INTEGER AS scheduled_days, step AS learning_steps, reps, lapses, state, make_timestamp(last) AS last_review
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lemma_id ORDER BY i DESC) AS rn FROM {folded}) WHERE rn = 1"""
CTES["replayed"] = _REPLAYED.format(folded="folded")


@query("d3_replay_reviews", "SELECT * FROM replayed")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _fsrs_columns(D.replay_reviews(S.reviews(spark, sf)))


@query("d3_replay_reviews_continued", "SELECT * FROM replayed")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The log in two parts: the second continues the cards of the first."""
    log = S.reviews(spark, sf)
    half = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    before = D.replay_reviews(log.filter(F.col("ts") < half))
    after = D.replay_reviews(log.filter(F.col("ts") >= half), initial=before)
    untouched = before.join(after, ["user_id", "lemma_id"], "left_anti")
    return _fsrs_columns(untouched.unionByName(after))


@query("d3_replay_reviews_streamed", "SELECT * FROM replayed")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every card in runs of two answers, as very long logs are folded."""
    return _fsrs_columns(D.replay_reviews(S.reviews(spark, sf), run_length=2))


@query("d4_due_cards", f"""
    SELECT user_id, lemma_id, due, ord::INTEGER AS ord FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY due, lemma_id) AS ord FROM cardsk WHERE due <= {TIME}) WHERE ord <= 20""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.due_cards(S.cards(spark, sf), S.now(), 20).select("user_id", "lemma_id", F.col("fsrs.due").alias("due"), "ord")


@query("d5_due_counts", f"SELECT user_id, count(*) FILTER (due <= {TIME}) AS due FROM cardsk GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.due_counts(S.cards(spark, sf), S.now())


CTES["bystate"] = """
    SELECT u.user_id, l.state, count(c.user_id) AS n FROM (SELECT DISTINCT user_id FROM cardsk) u
    CROSS JOIN (VALUES (0, 'new'), (1, 'learning'), (2, 'review'), (3, 'relearning')) l(no, state)
    LEFT JOIN cardsk c ON c.user_id = u.user_id AND c.state = l.no GROUP BY ALL"""


@query("d6_cards_by_state", "SELECT * FROM bystate")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.cards_by_state(S.cards(spark, sf))


@query("d7_next_due", "SELECT user_id, min(due) AS next_due FROM cardsk GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.next_due(S.cards(spark, sf))


@query("d8_cards_by_week", "SELECT user_id, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week_start, count(*) AS n FROM cardsk GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.cards_by_week(S.cards(spark, sf)).withColumn("week_start", F.col("week_start").cast("string"))


@query("d9_reading_statistics", """
    SELECT b.user_id, b.book_id, b.coverage, coalesce(o.n, 0) AS chapters_opened, coalesce(k.n, 0) AS vocabulary_known, coalesce(c.n, 0) AS cards_total, wk.by_week
    FROM book_rows b LEFT JOIN (SELECT user_id, string_agg(strftime(week, '%Y-%m-%d') || ' ' || n, ', ' ORDER BY week) AS by_week
        FROM (SELECT user_id, date_trunc('week', created_at) AS week, count(*) AS n FROM cardsw GROUP BY ALL) GROUP BY 1) wk USING (user_id) LEFT JOIN (SELECT user_id, book_id, count(DISTINCT chapter_index) AS n FROM readings GROUP BY ALL) o USING (user_id, book_id)
    LEFT JOIN (SELECT user_id, count(*) AS n FROM knownw GROUP BY 1) k USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS n FROM cardsw GROUP BY 1) c USING (user_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    books = Books(spark, sf)
    found = D.reading_statistics(N.known_provenance(books.cards, books.marks), books.cards, books.rows(), books.readings)
    week = F.transform("by_week", lambda w: F.concat_ws(" ", w["week_start"].cast("string"), w["n"].cast("string")))
    return found.withColumn("by_week", F.array_join(week, ", "))


@query("d10_due_by_chapter", f"""
    SELECT s.user_id, book_id, chapter_index, count(DISTINCT s.lemma_id) AS due FROM study_rows s JOIN cardsw c ON c.user_id = s.user_id AND c.lemma_id = s.lemma_id
    WHERE c.due <= {TIME} GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    study = Study(spark, sf)
    due = study.cards.filter(F.col("fsrs.due") <= S.now()).select("user_id", "lemma_id")
    rows = C.classify_opened(study.words_of(due), study.open, due, due.filter("false")).filter("is_known")
    return rows.groupBy("user_id", "book_id", "chapter_index").agg(F.count_distinct("lemma_id").alias("due"))


@query("d11_card_view", """
    SELECT user_id, lemma_id, lemma_id AS lemma, CASE WHEN stability > 3 THEN 'NOUN' ELSE '' END AS pos, de, en, example, region_note,
           stability > 3 AND lapses > 1 AS mexicanism FROM cardsk""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.card_view(S.cards(spark, sf))


@query("d12_get_cards", "SELECT user_id, lemma_id, reps FROM cardsk WHERE (user_id, lemma_id) IN (SELECT user_id, lemma_id FROM marksk)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return D.get_cards(S.cards(spark, sf), S.known_lemmas(spark, sf)).select("user_id", "lemma_id", F.col("fsrs.reps").alias("reps"))


# --- sessions ----------------------------------------------------------------------------------

# Sessions per reader and week: the words first met then, 18 to a session, with the week's events on them as answers.
CTES["weekly"] = f"""
    SELECT user_id, 'w' || strftime(ts, '%V') AS book_id, event_id AS seq, ts, {case('event_type', ACTION_OF)} AS action, k FROM ev WHERE k IS NOT NULL"""
CTES["scards"] = f"""
    SELECT user_id, book_id, (place // {K.MAX_CARDS_PER_SESSION})::INTEGER AS chapter_index, 'm' || k AS key, 'k' || k AS lemma_id,
           (place % {K.MAX_CARDS_PER_SESSION})::INTEGER AS ord, k
    FROM (SELECT user_id, book_id, k, row_number() OVER (PARTITION BY user_id, book_id ORDER BY min(seq)) - 1 AS place FROM weekly GROUP BY user_id, book_id, k)"""
CTES["slog"] = "SELECT user_id, book_id, chapter_index, seq, ts, action FROM weekly JOIN scards USING (user_id, book_id, k)"


def _session_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    week = F.concat(F.lit("w"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    events = S.events(spark, sf).filter(F.col("k").isNotNull()).withColumn("book_id", week)
    words = ["user_id", "book_id", "k"]
    place = F.row_number().over(Window.partitionBy("user_id", "book_id").orderBy("first")) - 1
    placed = events.groupBy(*words).agg(F.min("event_id").alias("first")).select(
        *words, F.floor(place / K.MAX_CARDS_PER_SESSION).cast("int").alias("chapter_index"),
        (place % K.MAX_CARDS_PER_SESSION).alias("ord"),
    )
    keys = ["user_id", "book_id", "chapter_index"]
    number = F.col("k").cast("string")
    cards = placed.select(*keys, "ord", F.concat(F.lit("m"), number).alias("key"), F.concat(F.lit("k"), number).alias("lemma_id"))
    log = events.join(placed, words).select(
        *keys, F.col("event_id").alias("seq"), "ts", S.mapped("event_type", S.ACTION_OF).alias("action"))
    return cards, log


_CARDLIST = "array_join(transform(queue, c -> concat(c.key, if(c.introduced, '+', '-'))), ' ')"


@query("e1_start_sessions", """
    SELECT user_id, book_id, chapter_index, string_agg(key || '-', ' ' ORDER BY ord) AS queue, count(*)::INTEGER AS total, 'introduction' AS phase FROM scards GROUP BY ALL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    started = E.start_sessions(_session_tables(spark, sf)[0])
    return started.select("user_id", "book_id", "chapter_index", F.expr(_CARDLIST).alias("queue"), "total", "phase")


CTES["nlog"] = "SELECT *, row_number() OVER (PARTITION BY user_id, book_id, chapter_index ORDER BY seq) AS i FROM slog"
CTES["sfold"] = """
    SELECT user_id, book_id, chapter_index, list({'key': key, 'intro': false} ORDER BY ord) AS q, []::VARCHAR[] AS passed, []::VARCHAR[] AS dismissed,
           NULL::TIMESTAMP AS updated, 0::BIGINT AS i, NULL::VARCHAR AS kind, NULL::VARCHAR AS ekey, NULL::VARCHAR AS grade, NULL::BIGINT AS seq, NULL::TIMESTAMP AS ts
    FROM scards GROUP BY user_id, book_id, chapter_index
    UNION ALL
    SELECT user_id, book_id, chapter_index,
           CASE WHEN pass OR dis THEN q[2:] WHEN fail THEN list_append(q[2:], q[1]) WHEN seen THEN list_append(q[2:], {'key': q[1].key, 'intro': true}) ELSE q END,
           CASE WHEN pass THEN list_append(passed, q[1].key) ELSE passed END, CASE WHEN dis THEN list_append(dismissed, q[1].key) ELSE dismissed END,
           CASE WHEN pass OR fail OR dis OR seen THEN nts ELSE updated END, ni,
           CASE WHEN dis THEN 'markKnown' WHEN pass OR fail THEN 'saveCard' END, CASE WHEN dis OR pass OR fail THEN q[1].key END,
           CASE WHEN pass OR fail THEN action END, nseq, nts
    FROM (SELECT f.*, l.i AS ni, l.seq AS nseq, l.ts AS nts, l.action,
                 len(q) > 0 AND coalesce(q[1].intro, false) AND l.action IN ('good', 'easy') AS pass, len(q) > 0 AND coalesce(q[1].intro, false) AND l.action IN ('again', 'hard') AS fail,
                 len(q) > 0 AND NOT coalesce(q[1].intro, true) AND l.action = 'ichKenneDas' AS dis, len(q) > 0 AND NOT coalesce(q[1].intro, true) AND l.action = 'weiter' AS seen
          FROM sfold f JOIN nlog l ON l.user_id = f.user_id AND l.book_id = f.book_id AND l.chapter_index = f.chapter_index AND l.i = f.i + 1)"""
CTES["sdone"] = """
    SELECT user_id, book_id, chapter_index, CASE WHEN len(q) = 0 THEN 'complete' WHEN q[1].intro THEN 'recall' ELSE 'introduction' END AS phase, q, passed, dismissed, updated
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, book_id, chapter_index ORDER BY i DESC) AS rn FROM sfold) WHERE rn = 1"""
_SESSION_SQL = """
    SELECT user_id, book_id, chapter_index, phase, list_aggregate(list_transform(q, lambda c: c.key || CASE WHEN c.intro THEN '+' ELSE '-' END), 'string_agg', ' ') AS queue,
           list_aggregate(passed, 'string_agg', ' ') AS passed, list_aggregate(dismissed, 'string_agg', ' ') AS dismissed, updated AS updated_at FROM sdone"""
_SESSION_SQL = (
    "SELECT user_id, book_id, chapter_index, phase, coalesce(queue, '') AS queue, coalesce(passed, '') AS passed, "
    "coalesce(dismissed, '') AS dismissed, updated_at FROM (" + _SESSION_SQL + ")"
)


def _session_rows(done: DataFrame) -> DataFrame:
    return done.select(
        "user_id", "book_id", "chapter_index", "phase", F.expr(_CARDLIST).alias("queue"),
        F.array_join("passed", " ").alias("passed"), F.array_join("dismissed", " ").alias("dismissed"), "updated_at",
    )


def _replayed(spark: SparkSession, sf: str, run_length: int = E.RUN_LENGTH) -> tuple[DataFrame, DataFrame]:
    cards, log = _session_tables(spark, sf)
    return E.replay_sessions(E.start_sessions(cards), log, run_length=run_length)


@query("e2_replay_sessions", _SESSION_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _session_rows(_replayed(spark, sf)[0])


@query("e2_replay_sessions_streamed", _SESSION_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _session_rows(_replayed(spark, sf, run_length=7)[0])


@query("e3_session_effects", """
    SELECT user_id, book_id, chapter_index, seq, ts, kind, 'k' || substr(ekey, 2) AS lemma_id, grade FROM sfold WHERE kind IS NOT NULL""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _replayed(spark, sf)[1]


# A sitting per reader: all cards due now, soonest first, all introduced.
CTES["due"] = f"""
    SELECT user_id, lemma_id, row_number() OVER (PARTITION BY user_id ORDER BY due, lemma_id) - 1 AS ord FROM cardsk WHERE due <= {TIME}"""
CTES["rlog"] = f"""
    SELECT user_id, event_id AS seq, ts, {case('event_type', GRADE_OF)} AS grade, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ev WHERE event_type <> 'signup'"""
CTES["rfold"] = """
    SELECT user_id, list(lemma_id ORDER BY ord) AS q, 0 AS passed, 0::BIGINT AS i, NULL::VARCHAR AS lemma_id, NULL::VARCHAR AS grade, NULL::BIGINT AS seq, NULL::TIMESTAMP AS ts FROM due GROUP BY user_id
    UNION ALL
    SELECT f.user_id, CASE WHEN len(q) = 0 THEN q WHEN l.grade IN ('good', 'easy') THEN q[2:] ELSE list_append(q[2:], q[1]) END,
           passed + CASE WHEN len(q) > 0 AND l.grade IN ('good', 'easy') THEN 1 ELSE 0 END, l.i, q[1], l.grade, l.seq, l.ts
    FROM rfold f JOIN rlog l ON l.user_id = f.user_id AND l.i = f.i + 1"""
_SITTING_SQL = """
    SELECT user_id, passed AS passed_count, len(q)::INTEGER AS remaining, q[1] AS current_key
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS rn FROM rfold) WHERE rn = 1"""


def _sitting(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    due = D.due_cards(S.cards(spark, sf), S.now()).select("user_id", "lemma_id", "ord")
    log = S.reviews(spark, sf).select("user_id", "seq", "ts", "grade")
    return E.replay_sittings(E.start_sittings(due), log)


@query("e4_replay_sittings", _SITTING_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    done, _ = _sitting(spark, sf)
    return E.session_progress(done, ["user_id"]).select("user_id", "passed_count", "remaining", "current_key")


@query("e4_sitting_reviews", "SELECT user_id, lemma_id, seq, grade FROM rfold WHERE lemma_id IS NOT NULL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    _, effects = _sitting(spark, sf)
    return E.effect_reviews(effects).select("user_id", "lemma_id", "seq", "grade")


CTES["sittings"] = f"""
    SELECT user_id, lemma_id, epoch_us(ts) AS us, {case('grade', {g: str(n) for n, g in enumerate(K.GRADES, 1)})}::INTEGER AS g,
           row_number() OVER (PARTITION BY user_id, lemma_id ORDER BY ts, seq) AS i FROM rfold WHERE lemma_id IS NOT NULL"""
CTES["sat"] = _fold_sql("sat", "sittings", """
    SELECT user_id, lemma_id, epoch_us(created_at) AS created, epoch_us(due) AS due, stability AS s, 5.0::DOUBLE AS d, 0::BIGINT AS elapsed,
           floor(stability / 10)::BIGINT AS scheduled, 0::INTEGER AS step, reps::INTEGER AS reps, lapses::INTEGER AS lapses, state::INTEGER AS state,
           epoch_us(last_review) AS last, 0::BIGINT AS i
    FROM cardsk WHERE (user_id, lemma_id) IN (SELECT user_id, lemma_id FROM sittings)""")


@query("e4_sitting_cards", _REPLAYED.format(folded="sat"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The cards after the sitting: its effects replayed onto the stored cards."""
    _, effects = _sitting(spark, sf)
    return _fsrs_columns(D.replay_reviews(E.effect_reviews(effects), initial=S.cards(spark, sf)))


@query("e5_session_progress", """
    SELECT user_id, book_id, chapter_index, phase, total, (len(passed) + len(dismissed))::INTEGER AS answered, round((len(passed) + len(dismissed))::DOUBLE / total, 6) AS fraction,
           len(q)::INTEGER AS remaining, len(passed)::INTEGER AS passed_count, len(dismissed)::INTEGER AS dismissed_count, q[1].key AS current_key
    FROM sdone JOIN (SELECT user_id, book_id, chapter_index, count(*)::INTEGER AS total FROM scards GROUP BY ALL) USING (user_id, book_id, chapter_index)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return E.session_progress(_replayed(spark, sf)[0])


@query("e6_session_card_view", """
    SELECT user_id, s.book_id, chapter_index, q[1].key AS key, coalesce(x.lemma, q[1].key) AS lemma, coalesce(x.pos, '') AS pos, x.de, x.mexicanism IS NOT NULL AND x.mexicanism AS mexicanism
    FROM sdone s LEFT JOIN (SELECT DISTINCT book_id, 'm' || k AS key, 'k' || k AS lemma, 'NOUN' AS pos, 'de ' || k AS de, k % 2 = 0 AS mexicanism FROM weekly WHERE k < 50) x
      ON x.book_id = s.book_id AND x.key = q[1].key WHERE len(q) > 0""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cards, _ = _session_tables(spark, sf)
    events = S.events(spark, sf).filter(F.col("k") < 50)
    number = F.col("k").cast("string")
    none = F.lit(None).cast("string")
    lexicon = events.select(
        F.concat(F.lit("w"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0")).alias("book_id"), F.concat(F.lit("m"), number).alias("key"),
        F.concat(F.lit("k"), number).alias("lemma"), F.lit("NOUN").alias("pos"), F.concat(F.lit("de "), number).alias("de"),
        none.alias("en"), none.alias("example"), none.alias("region_note"), (F.col("k") % 2 == 0).alias("mexicanism"),
    ).distinct()
    return E.session_card_view(_replayed(spark, sf)[0], lexicon).select(
        "user_id", "book_id", "chapter_index", "key", "lemma", "pos", "de", "mexicanism"
    )


@query("e7_track_state", """
    SELECT doc_id AS track_id, CASE WHEN toxic = 1 THEN 'archived' WHEN quality IS NULL THEN 'candidate' WHEN quality = 0 THEN 'no_lyrics' WHEN lang <> 'es' THEN 'not_spanish'
           WHEN source LIKE '%1' THEN 'unlocked' WHEN source LIKE '%2' THEN 'teaching' WHEN n_chars > 100 THEN 'ready' ELSE 'candidate' END AS state
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.table(spark, sf, "documents").join(S.table(spark, sf, "labels"), "doc_id", "left")
    return E.track_state(docs.select(
        F.col("doc_id").alias("track_id"), (F.col("toxic") == 1).alias("archived"), (F.col("quality") == 1).alias("lyrics"),
        (F.col("lang") == "es").alias("language_ok"),
        F.when(F.endswith("source", F.lit("1")), "complete").when(F.endswith("source", F.lit("2")), "recall").alias("session_phase"),
        (F.col("n_chars") > 100).alias("has_teach_set"),
    ))


# --- logs --------------------------------------------------------------------------------------

def _error_log(spark: SparkSession, sf: str) -> DataFrame:
    return S.events(spark, sf).filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("at"), F.concat(F.lit("error "), F.col("k").cast("string")).alias("message")
    )


def _import_log(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return S.events(spark, sf).filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("at"),
        F.when(k < 40, "book").when(k < 80, "known").otherwise("unrecognised").alias("file_shape"),
        F.when((k % 3 == 0) | (k >= 80), "failure").otherwise("success").alias("result"),
        F.when(k >= 80, "UnrecognisedFile").when((k % 3 == 0) & (k < 20), "UnsupportedVersion").when(k % 3 == 0, "Format").alias("error_name"),
    )


CTES["imports"] = """
    SELECT event_id AS id, user_id, ts AS at, CASE WHEN k < 40 THEN 'book' WHEN k < 80 THEN 'known' ELSE 'unrecognised' END AS file_shape,
           CASE WHEN k % 3 = 0 OR k >= 80 THEN 'failure' ELSE 'success' END AS result,
           CASE WHEN k >= 80 THEN 'UnrecognisedFile' WHEN k % 3 = 0 AND k < 20 THEN 'UnsupportedVersion' WHEN k % 3 = 0 THEN 'Format' END AS error_name
    FROM ev WHERE event_type = 'purchase'"""


@query("l1_ring_buffer", "SELECT event_id AS id, user_id, ts AS at, 'error ' || k AS message FROM ev WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 50")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.ring_buffer(_error_log(spark, sf), K.ERROR_LOG_CAP)


@query("l1_ring_buffer_per_reader", "SELECT id, user_id, result FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS rn FROM imports) WHERE rn <= 10")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.ring_buffer(_import_log(spark, sf), K.IMPORT_LOG_CAP, ["user_id"]).select("id", "user_id", "result")


@query("l2_last_import", "SELECT user_id, max(id) AS id, arg_max(file_shape, id) AS file_shape, arg_max(result, id) AS result FROM imports GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.last_import(_import_log(spark, sf), ["user_id"]).select("user_id", "id", "file_shape", "result")


@query("l3_reading_fraction", "SELECT id, fraction FROM positions")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return S.positions(spark, sf).select("id", "fraction")


CTES["latest"] = """
    SELECT user_id, book_id, chapter_index, arg_max(paragraph_id, (updated_at, id)) AS paragraph_id, arg_max(fraction, (updated_at, id)) AS fraction, max(updated_at) AS updated_at
    FROM positions GROUP BY ALL"""


@query("l4_latest_positions", "SELECT * FROM latest")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.latest_positions(S.positions(spark, sf))


@query("l5_resume_chapter", "SELECT user_id, book_id, arg_max(chapter_index, (updated_at, -chapter_index)) AS resume_index FROM latest GROUP BY ALL")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.resume_chapter(L.latest_positions(S.positions(spark, sf)))


CTES["shelf"] = """
    SELECT source AS book_id, 'Book ' || source AS title, count(*)::INTEGER AS chapter_count, TIMESTAMP '2024-01-01' + to_seconds((sum(n_chars) % 86400)::BIGINT) AS imported_at
    FROM documents GROUP BY source"""


@query("l6_library", "SELECT * FROM shelf ORDER BY imported_at DESC, book_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.library(S.books(spark, sf))


@query("l7_bookmark_list", """
    SELECT event_id AS id, user_id, b AS book_id, coalesce(s.title, b) AS book_title, chapter_index, 'note ' || k AS text, ts AS created_at
    FROM (SELECT *, CASE WHEN k % 10 = 0 THEN 'gone' ELSE book_id END AS b FROM readings) r LEFT JOIN shelf s ON s.book_id = b""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    bookmarks = S.readings(spark, sf).select(
        F.col("event_id").alias("id"), "user_id", F.when(F.col("k") % 10 == 0, "gone").otherwise(F.col("book_id")).alias("book_id"),
        "chapter_index", F.concat(F.lit("note "), F.col("k").cast("string")).alias("text"), F.col("ts").alias("created_at"),
    )
    return L.bookmark_list(bookmarks, S.books(spark, sf))


CTES["sizes"] = """
    SELECT s.book_id, s.title, coalesce(n, 0) AS lexicon_entries FROM (SELECT * FROM shelf UNION ALL SELECT 'empty ' || book_id, title, 0, imported_at FROM shelf) s
    LEFT JOIN (SELECT book_id, count(*) AS n FROM lex0 GROUP BY 1) USING (book_id)"""


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """All books, and beside each one without words, which shows zero."""
    books = S.books(spark, sf)
    empty = books.withColumn("book_id", F.concat(F.lit("empty "), "book_id"))
    return L.lexicon_sizes(books.unionByName(empty), V.lexicon_counts(S.counts_once(spark, sf)))


@query("l8_lexicon_sizes", "SELECT * FROM sizes")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _sizes(spark, sf)


@query("l9_open_sessions", """
    SELECT user_id, s.book_id, CASE WHEN s.book_id <> 'w01' THEN 'Week ' || s.book_id END AS book_title, chapter_index, phase, t.total, len(passed)::INTEGER AS passed, len(q)::INTEGER AS remaining, updated AS updated_at
    FROM sdone s JOIN (SELECT user_id, book_id, chapter_index, count(*)::INTEGER AS total FROM scards GROUP BY ALL) t USING (user_id, book_id, chapter_index) WHERE phase <> 'complete'""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    done, _ = _replayed(spark, sf)
    books = _session_tables(spark, sf)[0].select("book_id").distinct().filter(F.col("book_id") != "w01").select(
        "book_id", F.concat(F.lit("Week "), "book_id").alias("title")
    )
    return L.open_sessions(done, books)


@query("l10_schema_check", """
    SELECT 'documents' AS "table", column_name AS "column", expected, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' END AS live,
           coalesce(CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' END = expected, false) AS matches
    FROM (VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'), ('n_chars', 'int')) e(column_name, expected)
    LEFT JOIN (SELECT column_name AS cn, data_type FROM information_schema.columns WHERE table_name = 'documents') c ON c.cn = e.column_name""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.types import StructType

    expected = StructType.fromDDL("doc_id bigint, text string, lang string, source string, n_chars int")
    return L.schema_check(spark, {"documents": S.table(spark, sf, "documents")}, {"documents": expected})


@query("l11_import_failures", """
    SELECT CASE WHEN grouping(file_shape) = 1 THEN 'ALL' ELSE file_shape END AS file_shape, CASE WHEN grouping(error_name) = 1 THEN 'ALL' ELSE error_name END AS error_name, count(*) AS n
    FROM imports WHERE result = 'failure' GROUP BY ROLLUP (file_shape, error_name)""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return L.import_failures(_import_log(spark, sf))


@query("l12_diagnostics", """
    SELECT user_id::VARCHAR AS user_id, 'known' AS section, name, value::VARCHAR AS value FROM (UNPIVOT provenance ON seed, manual, legacy, matured_only, total INTO NAME name VALUE value)
    UNION ALL SELECT user_id::VARCHAR, 'cards', state, n::VARCHAR FROM bystate
    UNION ALL SELECT user_id::VARCHAR, 'cards', 'next_due', strftime(min(due), '%Y-%m-%d %H:%M:%S') FROM cardsk GROUP BY ALL
    UNION ALL SELECT user_id::VARCHAR, 'sessions', 'open', count(*)::VARCHAR FROM sdone WHERE phase <> 'complete' GROUP BY ALL
    UNION ALL SELECT user_id::VARCHAR, 'errors', 'rows', least(count(*), 50)::VARCHAR FROM ev WHERE event_type = 'error' GROUP BY ALL
    UNION ALL SELECT user_id::VARCHAR, 'imports', 'rows', least(count(*), 10)::VARCHAR FROM imports GROUP BY ALL
    UNION ALL SELECT user_id::VARCHAR, 'imports', 'last_result', arg_max(result, id) FROM imports GROUP BY ALL
    UNION ALL SELECT NULL, 'lexicon', book_id, lexicon_entries::VARCHAR FROM sizes""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cards = S.cards(spark, sf)
    return L.diagnostics(
        N.known_provenance(cards, S.known_lemmas(spark, sf)), D.cards_by_state(cards), D.next_due(cards),
        E.open_only(_replayed(spark, sf)[0]), _error_log(spark, sf), _import_log(spark, sf), _sizes(spark, sf),
    ).withColumn("user_id", F.col("user_id").cast("string"))


# --- streams -----------------------------------------------------------------------------------

def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream; the table is one file or a folder of part files."""
    stream = W.read_table(spark, f"{sf}/events.parquet", S.table(spark, sf, "events").schema)
    return stream.select(
        "event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k")
    )


def _review_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _event_stream(spark, sf).filter(F.col("event_type") != "signup").select(
        "user_id", F.concat(F.lit("k"), F.col("k").cast("string")).alias("lemma_id"), "ts", F.col("event_id").alias("seq"),
        S.mapped("event_type", S.GRADE_OF).alias("grade"),
    )


@query("w1_stream_card_state", """
    SELECT f.user_id, f.lemma_id, s AS stability, d AS difficulty, reps, lapses, state
    FROM folded f JOIN (SELECT user_id, lemma_id, count(*) AS n FROM answers WHERE us // 1000 <= (SELECT max(us) // 1000 FROM answers) - 3600000 GROUP BY ALL) c
      ON c.user_id = f.user_id AND c.lemma_id = f.lemma_id AND f.i = c.n""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Newest state per card after the stream; equals the batch replay up to the watermark."""
    out = W.run_cards(_review_stream(spark, sf), shared_folder(spark, "cards"))
    newest = out.groupBy("user_id", "lemma_id").agg(F.max_by(F.struct("stability", "difficulty", "reps", "lapses", "state"), "reps").alias("_c"))
    return newest.select("user_id", "lemma_id", "_c.*")


@query("w2_stream_candidates", """
    WITH p AS (SELECT user_id, 'k' || k AS track_key, ts FROM ev WHERE event_type <> 'signup'),
    x AS (SELECT user_id, track_key, date_trunc('day', ts) - to_days(o::INTEGER) AS window_start FROM p, range(0, 30) r(o)),
    c AS (SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, user_id, track_key, count(*) AS plays FROM x GROUP BY ALL)
    SELECT * FROM c WHERE plays >= 3 AND window_end <= (SELECT max(ts) FROM p) - INTERVAL 1 DAY""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    plays = _review_stream(spark, sf).select("user_id", F.col("lemma_id").alias("track_key"), "ts")
    out = W.run_candidates(plays, shared_folder(spark, "candidates"))
    return out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "user_id", "track_key", "plays",
    )


@query("w3_stream_dedupe", "SELECT event_id, user_id, event_type FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Every event delivered twice, kept once."""
    twice = _event_stream(spark, sf)
    out = W.run_to_table(W.stream_dedupe(twice.union(_event_stream(spark, sf))), shared_folder(spark, "dedupe"))
    return out.select("event_id", "user_id", "event_type")


@query("w4_stream_cards_by_week", """
    WITH c AS (SELECT user_id, date_trunc('week', ts)::DATE AS week_start, count(*) AS n FROM ev WHERE event_type = 'signup' GROUP BY ALL)
    SELECT user_id, strftime(week_start, '%Y-%m-%d') AS week_start, n FROM c WHERE week_start + INTERVAL 7 DAY <= (SELECT max(ts) FROM ev WHERE event_type = 'signup') - INTERVAL 1 DAY""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    added = _event_stream(spark, sf).filter(F.col("event_type") == "signup").select("user_id", F.col("ts").alias("created_at"))
    return W.run_to_table(W.stream_cards_by_week(added), shared_folder(spark, "weeks")).withColumn(
        "week_start", F.col("week_start").cast("string")
    )


@query("w5_stream_sittings", """
    WITH r AS (SELECT user_id, ts FROM ev WHERE event_type <> 'signup'),
    b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cutoff FROM r),
    g AS (SELECT *, sum(cutoff) OVER (PARTITION BY user_id ORDER BY ts) AS sitting FROM b)
    SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTE AS ended_at, count(*) AS answers FROM g GROUP BY user_id, sitting
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM r) - INTERVAL 1 HOUR""")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = W.run_to_table(W.stream_sittings(_review_stream(spark, sf)), shared_folder(spark, "sittings"))
    return out.select(
        "user_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"), "answers"
    )
