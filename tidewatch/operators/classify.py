"""Batch classification and lifecycle.

``classify_batch`` resolves every posting of a batch against the known entities the way a
row-by-row pass in batch order would (id hit -> repost within the window -> reopen a closed
record -> new), but as set operations:

* **identity** (C1): pre-aggregated equi-join on (company, source id); repeated ids inside
  the batch follow the first row with that id;
* **exact fast path**: a leader whose (company, sorted title, location) equals an eligible
  candidate scores 1.0, the maximum, so it is settled by an equi-join on that key;
* **fuzzy edges**: remaining leaders are scored at signature level against the eligible
  candidates of their company (see ``linkage``), with "eligible" depending on batch order:
  a known record is in the window if its last_seen is recent or an earlier row of the batch
  hit it; a batch candidate must be an earlier leader;
* **cascades**: only where a leader has an edge to a closed record and no repost edge can a
  reopen happen, which changes later decisions. The companies with such a leader are decided by a
  fixed point of set-wise rounds over edges and ids (see ``_cascade``); all others in one step.

Outputs: a ``decisions`` row per posting, the updated entity table, and the new rows of the
observation log. Record ids of inserts are ``sha2(run_id|company|batch_seq)``, so a retried
task or a rerun yields the same ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import similarity as S
from tidewatch.functions.normalize import with_signature
from tidewatch.operators.linkage import format_2f, score_signature_pairs
from tidewatch.session import ensure_checkpoint_dir

# Reason texts (this one and the two that are built below).
NEW_REASON = "New job posting (no previous match found)"
DEFAULT_WINDOW_DAYS = 30
DEFAULT_CLOSE_TIMEOUT_DAYS = 14

ENTITY_COLUMNS = [
    "id", "entity_seq", "company_id", "company_name", "title", "location", "url", "signature",
    "title_norm", "title_sorted", "location_norm", "classification", "classification_reasoning",
    "status", "first_seen", "last_seen", "source_identifier", "department", "description",
    "created_at", "updated_at",
]

DECISION_COLUMNS = [
    "batch_seq", "company_id", "decision", "entity_id", "target_id", "target_kind", "score",
    "target_first_seen",
]


@dataclass
class ClassifyResult:
    decisions: DataFrame
    entities: DataFrame
    observations: DataFrame


def _ckpt(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (shared checkpoint dir): cuts lineage, and a lost executor
    recomputes from the checkpoint instead of from the sources."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _ts(value) -> F.Column:
    if isinstance(value, datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def _new_id(run_id: str) -> F.Column:
    return F.sha2(F.concat_ws("|", F.lit(run_id), F.col("company_id"), F.col("batch_seq").cast("string")), 256)


# ---------------------------------------------------------------------------
# Reopen cascades: a fixed point over whole rounds of decisions.
# ---------------------------------------------------------------------------

_ALWAYS, _FOREVER = -(1 << 62), 1 << 62


def _effect() -> F.Column:
    """What a decision changes for other rows: a record of its own ('new' or 'repost' alike), a hit or
    a reopening of a known record, or nothing."""
    return F.when(F.col("decision").isin("new", "repost"), "born").when(
        F.col("ref").startswith("K:"), F.concat_ws(" ", "decision", "ref"))


def _steps(told: DataFrame, known: DataFrame) -> DataFrame:
    """(role, key, falling, at, cand): which record answers for a key at a row, by what ``told`` says.

    Roles: 'id' (holder of a source id), 'recent' and 'closed' (records of a signature that can be
    matched, or reopened). A record answers for the rows after ``at`` (``falling``: up to ``at``);
    of each key only the records that are the earliest for some row are kept, since one that comes no
    sooner (goes no later) than an earlier record is never chosen."""
    event = told.where("decision IN ('existing', 'reopened') AND ref LIKE 'K:%'").groupBy("ref").agg(
        F.min(F.when(F.col("decision") == "reopened", F.struct("batch_seq", "sid"))).alias("took"),
        F.min(F.when(F.col("decision") == "existing", F.col("batch_seq"))).alias("hit_at"))
    entry = lambda role, key, at, falling: F.struct(F.lit(role).alias("role"), key.alias("key"), at.alias("at"), F.lit(falling).alias("falling"))
    id_key = lambda sid: F.concat(F.col("company_id"), F.lit("\x1f"), F.nullif(F.col(sid), F.lit("")))
    said = lambda *entries: F.inline(F.filter(F.array(*entries), lambda e: e["key"].isNotNull() & e["at"].isNotNull()))
    gone = F.coalesce("took.batch_seq", F.lit(_FOREVER))
    begins = F.when(F.col("closed"), F.col("took.batch_seq")).when(F.col("in_window"), F.lit(_ALWAYS)).otherwise(F.col("hit_at"))
    records = known.join(event, "ref", "left").select("cand", said(
        entry("id", id_key("sid"), gone, True), entry("id", id_key("took.sid"), F.col("took.batch_seq"), False),
        entry("recent", F.col("sig"), begins, False), entry("closed", F.when(F.col("closed"), F.col("sig")), gone, True)))
    seq = F.col("batch_seq")
    born = told.where("decision IN ('new', 'repost')").select(
        F.struct(F.lit(1).alias("kind"), seq.alias("seq"), F.concat(F.lit("B:"), seq.cast("string")).alias("ref")).alias("cand"),
        said(entry("id", id_key("sid"), seq, False), entry("recent", F.col("sig"), seq, False)))
    key = ["role", "key", "falling"]
    every = records.groupBy(*key, "at").agg(F.min("cand").alias("cand")).unionByName(
        born.groupBy(*key).agg(F.min("at").alias("at"), F.min("cand").alias("cand")))
    sooner = Window.partitionBy(*key).orderBy(F.when(F.col("falling"), -F.col("at")).otherwise(F.col("at")), "cand").rowsBetween(
        Window.unboundedPreceding, -1)
    return every.withColumn("best", F.min("cand").over(sooner)).where("best IS NULL OR cand < best").drop("best")


_HOLDS = "(NOT falling AND batch_seq > at) OR (falling AND batch_seq <= at)"


def _wave(told: DataFrame, steps: DataFrame, links: DataFrame) -> DataFrame:
    """Decisions of the rows of ``told``, each from the records that answer at it; ``was`` and ``was_ref``
    are what ``told`` says, ``moved`` where that differs for other rows (see ``_effect``)."""
    own = [c for c in told.columns if c not in ("decision", "ref", "score")]
    rows = told.select(*own, F.col("ref").alias("was_ref"), _effect().alias("was"))
    # an equal signature has the highest score there is; token sets (M3) may tie with other signatures
    looks = rows.select("batch_seq", F.inline(F.filter(F.array(
        F.struct(F.lit("id").alias("role"), F.concat("company_id", F.lit("\x1f"), "sid").alias("key")),
        F.struct(F.lit("recent").alias("role"), F.when(~F.col("company_id").contains(S.SEPARATOR), F.col("sig")).alias("key"))),
        lambda e: e["key"].isNotNull())))
    plain = looks.join(steps.where("role != 'closed'"), ["key", "role"]).where(_HOLDS).groupBy("batch_seq").agg(F.min(F.struct(
        F.when(F.col("role") == "id", "existing").otherwise("repost").alias("decision"), "cand",  # in this order
        F.when(F.col("role") == "recent", F.lit(1.0)).alias("score"))).alias("got"))
    options = steps.where("role != 'id'").withColumnRenamed("key", "c_sig")
    similar = rows.join(plain, "batch_seq", "left_anti").join(links, "sig").join(options, "c_sig").where(_HOLDS).groupBy("batch_seq").agg(
        F.max_by(F.struct(F.when(F.col("role") == "recent", "repost").otherwise("reopened").alias("decision"), "cand", "score"),
                 F.struct("role", "score", -F.col("cand.kind"), -F.col("cand.seq"))).alias("got"))  # 'recent' before 'closed'
    return rows.join(plain.unionByName(similar), "batch_seq", "left").select(
        *own, "was", "was_ref", F.coalesce("got.decision", F.lit("new")).alias("decision"), F.col("got.cand.ref").alias("ref"),
        F.col("got.score").alias("score")).withColumn("moved", ~_effect().eqNullSafe(F.col("was")))


def _asked_again(told: DataFrame, moved: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (batch_seq) that look at an id or signature for which another record may answer now: those of
    the rows that moved, and of the records that they took, hit or left."""
    refs = moved.select(F.explode(F.array("ref", "was_ref")).alias("ref")).where("ref LIKE 'K:%'").distinct()
    cols = ["company_id", "sid", "sig"]
    theirs = moved.select(*cols).unionByName(known.join(refs, "ref", "left_semi").select(*cols)).unionByName(
        told.where("decision = 'reopened'").join(refs, "ref", "left_semi").select(*cols))
    ids = theirs.where("sid IS NOT NULL").select("sid", "company_id").distinct()
    sigs = theirs.select("sig").distinct()
    near = sigs.unionByName(links.join(sigs.withColumnRenamed("sig", "c_sig"), "c_sig", "left_semi").select("sig")).distinct()
    rows = told.select("batch_seq", "company_id", "sid", "sig")
    return rows.join(ids, ["sid", "company_id"], "left_semi").select("batch_seq").unionByName(rows.join(near, "sig", "left_semi").select("batch_seq")).distinct()


def _cascade(told: DataFrame, known: DataFrame, links: DataFrame) -> DataFrame:
    """Decisions in batch order, as the fixed point of ``_wave``.

    A row's decision depends on earlier rows of its company only, so after n rounds all rows are
    right whose chain of dependencies has at most n links, the fixed point is the only one, and the
    rounds needed are the links of the longest chain, not the rows. Every round is a set of joins
    over the rows of the companies that moved in the round before, and asks again only the rows that
    look at what moved; no component, company or chain is ever in one task.

    ``told``: batch_seq, company_id, sid, sig, a first guess (decision, ref) and what is to be passed on;
    ``known``: ref, company_id, sig, sid, closed, in_window, cand (kind 0, seq, ref);
    ``links``: sig, c_sig, score."""
    settled, kept = [], None
    asked = told
    while True:
        now = _ckpt(_wave(asked, _ckpt(_steps(told, known)), links))
        moved = now.where("moved")
        now = now.drop("moved", "was", "was_ref")
        now = now if kept is None else kept.unionByName(now)
        if moved.isEmpty():
            return reduce(DataFrame.unionByName, settled, now)
        where = moved.select("company_id").distinct()
        settled.append(now.join(where, "company_id", "left_anti").select(*now.columns))
        told = _ckpt(now.join(where, "company_id", "left_semi").select(*now.columns))
        again = _ckpt(_asked_again(told, moved, known, links))
        asked = told.join(again, "batch_seq", "left_semi").select(*told.columns)
        kept = told.join(again, "batch_seq", "left_anti").select(*told.columns)


# ---------------------------------------------------------------------------
# classify_batch
# ---------------------------------------------------------------------------


def classify_batch(entities: DataFrame, batch: DataFrame, now, window_days: int = DEFAULT_WINDOW_DAYS,
                   threshold: float = S.DEFAULT_THRESHOLD, run_id: str = "run", checkpoint: bool = True) -> ClassifyResult:
    t = S.check_threshold(threshold)
    now_dt = now if isinstance(now, datetime) else datetime.fromisoformat(str(now))
    cutoff_dt = now_dt - pd.Timedelta(days=window_days).to_pytimedelta()
    now_c, cutoff_c = _ts(now_dt), _ts(cutoff_dt)

    # The known set is read by many branches of this plan: materialise it once in the shared
    # checkpoint dir, which also keeps every later plan short (analysis cost grows with depth).
    K = entities.select(*ENTITY_COLUMNS)
    if checkpoint:
        K = _ckpt(K)
    R = with_signature(batch).withColumn(
        "sid", F.when(F.col("source_identifier") == "", F.lit(None)).otherwise(F.col("source_identifier"))
    )

    # --- C1 identity -----------------------------------------------------------------
    idx = (
        K.where(F.col("source_identifier").isNotNull() & (F.col("source_identifier") != ""))
        .groupBy(F.col("source_identifier").alias("sid"), "company_id")
        .agg(F.min_by("id", "entity_seq").alias("hit_id"))
    )
    lead = R.where(F.col("sid").isNotNull()).groupBy("sid", "company_id").agg(
        F.min("batch_seq").alias("lead_seq"), F.count(F.lit(1)).alias("sid_rows"))
    # the id is the first key: rows are sorted by it, and companies share their beginnings
    R2 = R.join(idx, ["sid", "company_id"], "left").join(lead, ["sid", "company_id"], "left").withColumn(
        "role",
        F.when(F.col("hit_id").isNotNull(), "hit")
        .when(F.col("lead_seq").isNotNull() & (F.col("lead_seq") != F.col("batch_seq")), "follower")
        .otherwise("leader"),
    )
    if checkpoint:
        R2 = _ckpt(R2)

    first_hit = R2.where(F.col("role") == "hit").groupBy(F.col("hit_id").alias("id")).agg(
        F.min("batch_seq").alias("first_hit_seq")
    )
    K1 = K.join(first_hit, "id", "left").select(
        "id", "entity_seq", "company_id", "title_sorted", "location_norm", "status", "last_seen", "first_seen",
        "source_identifier", "first_hit_seq")
    if checkpoint:
        K1 = _ckpt(K1)
    in_window = F.col("last_seen") >= cutoff_c
    # Candidate known records: closed (reopen), or in the window now / after an earlier id hit.
    Kc = K1.where((F.col("status") == "closed") | in_window | F.col("first_hit_seq").isNotNull()).select(
        "id", "entity_seq", "company_id", "title_sorted", "location_norm", "status", "last_seen", "first_seen",
        "source_identifier",
        F.when(F.col("status") == "closed", F.lit("C")).otherwise(F.lit("K")).alias("ckind"),
        # repost candidates: NULL = eligible for every row; else eligible for rows after it
        F.when(in_window, F.lit(None).cast("bigint")).otherwise(F.col("first_hit_seq")).alias("elig_from"),
    )

    L = R2.where(F.col("role") == "leader")

    # --- exact fast path -------------------------------------------------------------
    exk = (
        Kc.where(F.col("ckind") == "K")
        .groupBy("company_id", "title_sorted", "location_norm", "elig_from")
        .agg(F.min("entity_seq").alias("x_seq"), F.min_by("id", "entity_seq").alias("x_id"),
             F.min_by("first_seen", "entity_seq").alias("x_first"))
    )
    # the earliest candidate that is eligible before a leader: a running minimum along the batch,
    # linear in leaders and candidates of a signature
    sig = ["company_id", "title_sorted", "location_norm"]
    steps = L.select(*sig, F.col("batch_seq").alias("pos"), F.lit(0).alias("turn"), F.col("batch_seq"),
                     F.lit(None).cast("struct<x_seq: bigint, x_id: string, x_first: timestamp_ntz>").alias("cand")).unionByName(
        exk.select(*sig, F.coalesce("elig_from", F.lit(-1)).alias("pos"), F.lit(1).alias("turn"), F.lit(None).cast("bigint").alias("batch_seq"),
                   F.struct(F.col("x_seq").cast("bigint").alias("x_seq"), "x_id", "x_first").alias("cand")))
    upto = Window.partitionBy(*sig).orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact_k = steps.withColumn("best", F.min("cand").over(upto)).where(F.col("batch_seq").isNotNull() & F.col("best").isNotNull()).select(
        "batch_seq", F.struct(F.col("best.x_id").alias("x_id"), F.col("best.x_first").alias("x_first")).alias("xk"))
    exb = L.groupBy("company_id", "title_sorted", "location_norm").agg(F.min("batch_seq").alias("xb_seq"))
    L2 = (
        L.join(exb, ["company_id", "title_sorted", "location_norm"], "left")
        .join(exact_k, "batch_seq", "left")
        .withColumn("xb_seq", F.when(F.col("xb_seq") < F.col("batch_seq"), F.col("xb_seq")))
        .withColumn("is_exact", F.col("xk").isNotNull() | F.col("xb_seq").isNotNull())
    )

    # --- fuzzy edges for the residue -----------------------------------------------------
    residue = L2.where(~F.col("is_exact"))
    cs_k = Kc.groupBy(*sig, "ckind", F.when(F.col("ckind") == "K", F.col("elig_from")).alias("elig_from")).agg(
        F.min("entity_seq").alias("cseq"), F.min_by("id", "entity_seq").alias("cid"),
        F.min_by("first_seen", "entity_seq").alias("cfirst"),
    )
    # of a signature's records only those are kept that are the earliest for some row, however many were hit
    sooner = Window.partitionBy(*sig, "ckind").orderBy(F.col("elig_from").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    cs_k = cs_k.withColumn("best", F.min("cseq").over(sooner)).where("best IS NULL OR cseq IS NULL OR cseq < best").drop("best")
    cs_b = L.groupBy("company_id", "title_sorted", "location_norm").agg(F.min("batch_seq").alias("cseq")).select(
        "company_id", "title_sorted", "location_norm", F.lit("B").alias("ckind"),
        F.lit(None).cast("bigint").alias("elig_from"), "cseq",
        F.lit(None).cast("string").alias("cid"), F.lit(None).cast("timestamp_ntz").alias("cfirst"),
    )
    cs = cs_k.unionByName(cs_b)
    # One scoring pass: every batch signature against every candidate signature (known
    # candidates and batch signatures) of its company. Shared by the set-wise path (residue
    # leaders only) and the cascades (all rows of routed companies).
    sig_cands = Kc.select("company_id", "title_sorted", "location_norm").unionByName(R2.select("company_id", "title_sorted", "location_norm"))
    sp_all = score_signature_pairs(R2, sig_cands, t)
    if checkpoint:
        sp_all = _ckpt(sp_all)
    sp = sp_all
    edges = (
        residue.select("batch_seq", "company_id", F.col("title_sorted").alias("q_title"), F.col("location_norm").alias("q_loc"))
        .join(sp, ["company_id", "q_title", "q_loc"])
        .join(cs.withColumnRenamed("title_sorted", "c_title").withColumnRenamed("location_norm", "c_loc"),
              ["company_id", "c_title", "c_loc"])
        .where(
            ((F.col("ckind") == "K") & (F.col("elig_from").isNull() | (F.col("elig_from") < F.col("batch_seq"))))
            | ((F.col("ckind") == "B") & (F.col("cseq") < F.col("batch_seq")))
            | (F.col("ckind") == "C")
        )
    )
    kind_pref = F.when(F.col("ckind") == "K", 1).otherwise(0)
    best = edges.groupBy("batch_seq").agg(
        F.max_by(
            F.when(F.col("ckind") != "C", F.struct("ckind", "cseq", "cid", "cfirst", "score")),
            F.when(F.col("ckind") != "C", F.struct(F.col("score"), kind_pref, -F.col("cseq"))),
        ).alias("rp"),
        F.max_by(F.when(F.col("ckind") == "C", F.col("cid")), F.when(F.col("ckind") == "C", F.struct(F.col("score"), -F.col("cseq")))).alias("closed_id"),
    )
    # read by the routing and by the decisions: the search for matches is run once
    L3 = _ckpt(L2.join(best, "batch_seq", "left").select("batch_seq", "company_id", "is_exact", "xk", "xb_seq", "rp", "closed_id"))
    # --- routing: companies with a possible reopen ------------------------------------------
    triggers = L3.where(~F.col("is_exact") & F.col("rp").isNull() & F.col("closed_id").isNotNull()).select(
        "batch_seq", "company_id", "closed_id")
    routed = _ckpt(triggers.select("company_id").distinct())
    any_trigger = not routed.isEmpty()
    routed_rows = R2.join(routed, "company_id", "left_semi")

    # --- set-wise decisions (all other companies) -------------------------------------------
    L4 = L3.join(routed, "company_id", "left_anti")
    tk = F.when(F.col("xk").isNotNull(), F.lit("K")).when(F.col("xb_seq").isNotNull(), F.lit("B")).otherwise(F.col("rp.ckind"))
    lead_dec = L4.select(
        "batch_seq", "company_id",
        F.when(F.col("is_exact") | F.col("rp").isNotNull(), F.lit("repost")).otherwise(F.lit("new")).alias("decision"),
        _new_id(run_id).alias("entity_id"),
        F.when(F.col("xk").isNotNull(), F.col("xk.x_id"))
        .when(F.col("xb_seq").isNotNull(), F.sha2(F.concat_ws("|", F.lit(run_id), F.col("company_id"), F.col("xb_seq").cast("string")), 256))
        .when(F.col("rp.ckind") == "K", F.col("rp.cid"))
        .when(F.col("rp.ckind") == "B", F.sha2(F.concat_ws("|", F.lit(run_id), F.col("company_id"), F.col("rp.cseq").cast("string")), 256))
        .alias("target_id"),
        tk.alias("target_kind"),
        F.when(F.col("is_exact"), F.lit(1.0)).otherwise(F.col("rp.score")).alias("score"),
        F.when(F.col("xk").isNotNull(), F.col("xk.x_first"))
        .when(F.col("xb_seq").isNotNull(), now_c)
        .when(F.col("rp.ckind") == "K", F.col("rp.cfirst"))
        .when(F.col("rp.ckind") == "B", now_c)
        .alias("target_first_seen"),
    )
    R_unrouted = R2.join(routed, "company_id", "left_anti")
    hit_dec = R_unrouted.where(F.col("role") == "hit").select(
        "batch_seq", "company_id", F.lit("existing").alias("decision"), F.col("hit_id").alias("entity_id"),
        F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("target_kind"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("timestamp_ntz").alias("target_first_seen"),
    )
    fol_dec = R_unrouted.where(F.col("role") == "follower").select(
        "batch_seq", "company_id", F.lit("existing").alias("decision"),
        F.sha2(F.concat_ws("|", F.lit(run_id), F.col("company_id"), F.col("lead_seq").cast("string")), 256).alias("entity_id"),
        F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("target_kind"),
        F.lit(None).cast("double").alias("score"), F.lit(None).cast("timestamp_ntz").alias("target_first_seen"),
    )

    # --- cascade (routed companies) -----------------------------------------------------
    sig_of = lambda title, loc: F.concat_ws("\x1f", "company_id", title, loc)
    if any_trigger:
        guess = routed_rows.join(triggers.select("batch_seq", "closed_id"), "batch_seq", "left").select(
            "batch_seq", "company_id", F.col("sid").alias("new_sid"), "url",
            # an id that no record and no other row has need not be asked for
            F.when((F.col("role") == "hit") | (F.col("sid_rows") > 1), F.col("sid")).alias("sid"),
            sig_of("title_sorted", "location_norm").alias("sig"),
            F.when(F.col("role") != "leader", "existing").when(F.col("closed_id").isNotNull(), "reopened").otherwise("new").alias("decision"),
            F.when(F.col("role") == "hit", F.concat(F.lit("K:"), F.col("hit_id")))
            .when(F.col("role") == "follower", F.concat(F.lit("B:"), F.col("lead_seq").cast("string")))
            .otherwise(F.concat(F.lit("K:"), F.col("closed_id"))).alias("ref"))
        # records that can be reopened or matched, and every holder of an id that a row carries: if the
        # first holder takes another id by being reopened, the next one answers for it
        Kc_all = K1.join(routed, "company_id", "left_semi")
        row_sids = routed_rows.where(F.col("sid").isNotNull()).select("company_id", F.col("sid").alias("source_identifier")).distinct()
        held = Kc_all.join(row_sids.withColumn("held", F.lit(True)), ["company_id", "source_identifier"], "left")
        ref = F.concat(F.lit("K:"), F.col("id"))
        known = _ckpt(held.where((F.col("status") == "closed") | in_window | F.col("held")).select(
            ref.alias("ref"), "company_id", sig_of("title_sorted", "location_norm").alias("sig"),
            F.when(F.col("held"), F.col("source_identifier")).alias("sid"), "status", (F.col("status") == "closed").alias("closed"), in_window.alias("in_window"),
            F.struct(F.lit(0).alias("kind"), F.col("entity_seq").alias("seq"), ref.alias("ref")).alias("cand")))
        links = _ckpt(sp_all.join(routed, "company_id", "left_semi").select(
            sig_of("q_title", "q_loc").alias("sig"), sig_of("c_title", "c_loc").alias("c_sig"), "score"))
        done = _cascade(_ckpt(guess), known, links)
    else:
        none = R2.sparkSession.createDataFrame
        done = none([], "batch_seq bigint, company_id string, new_sid string, url string, sid string, sig string, decision string, ref string, score double")
        known = none([], "ref string, status string")

    def _ref_to_id(c):
        return (
            F.when(c.startswith("K:"), F.substring(c, 3, 1 << 30))
            .when(c.startswith("B:"), F.sha2(F.concat_ws("|", F.lit(run_id), F.col("company_id"), F.substring(c, 3, 1 << 30)), 256))
        )

    kfirst = K.select(F.concat(F.lit("K:"), F.col("id")).alias("target_ref"), F.col("first_seen").alias("kf"))
    target = F.when(F.col("decision").isin("repost", "reopened"), F.col("ref"))
    own = F.concat(F.lit("B:"), F.col("batch_seq").cast("string"))
    rep_dec = (
        done.withColumns({"target_ref": target, "entity_ref": F.when(F.col("decision").isin("new", "repost"), own).otherwise(F.col("ref"))})
        .join(kfirst, "target_ref", "left")
        .select(
            "batch_seq", "company_id", "decision",
            _ref_to_id(F.col("entity_ref")).alias("entity_id"),
            _ref_to_id(F.col("target_ref")).alias("target_id"),
            F.substring("target_ref", 1, 1).alias("target_kind"),
            "score",
            F.when(F.col("target_ref").startswith("B:"), now_c).otherwise(F.col("kf")).alias("target_first_seen"),
        )
    )
    decisions = lead_dec.unionByName(hit_dec).unionByName(fol_dec).unionByName(rep_dec)
    if checkpoint:
        decisions = _ckpt(decisions)

    # --- apply ------------------------------------------------------------------------
    rows = R2.select("batch_seq", "company_id", "company_name", "title", "location", "url", "source_identifier",
                     "department", "description", "signature", "title_norm", "title_sorted", "location_norm")
    dec_rows = decisions.join(rows, ["batch_seq", "company_id"])
    seq_base = K.agg(F.max("entity_seq")).first()[0]
    seq_base = (seq_base if seq_base is not None else 0) + 1
    reason_repost = F.concat(
        F.lit("Likely repost of job "), F.col("target_id"), F.lit(" (similarity: "),
        format_2f(F.col("score")), F.lit(", first seen: "), F.date_format("target_first_seen", "yyyy-MM-dd"), F.lit(")"),
    )
    inserts = dec_rows.where(F.col("decision").isin("new", "repost")).select(
        F.col("entity_id").alias("id"),
        (F.lit(seq_base) + F.col("batch_seq")).alias("entity_seq"),
        "company_id", "company_name", "title", "location", "url", "signature", "title_norm", "title_sorted",
        "location_norm",
        F.col("decision").alias("classification"),
        F.when(F.col("decision") == "new", F.lit(NEW_REASON)).otherwise(reason_repost).alias("classification_reasoning"),
        F.lit("active").alias("status"),
        now_c.alias("first_seen"), now_c.alias("last_seen"),
        "source_identifier", "department", "description",
        now_c.alias("created_at"), now_c.alias("updated_at"),
    )
    # updates of known records: id hits set-wise, and the final states of the cascades
    upd_set = (
        hit_dec.select(F.col("entity_id").alias("id")).distinct()
        .select("id", F.lit(None).cast("string").alias("u_status"), F.lit(True).alias("u_hit"),
                F.lit(None).cast("string").alias("u_sid"), F.lit(None).cast("string").alias("u_url"))
    )
    touched = done.where("decision IN ('existing', 'reopened') AND ref LIKE 'K:%'").groupBy("ref").agg(
        F.max(F.when(F.col("decision") == "reopened", F.struct(F.col("new_sid").alias("sid"), "url"))).alias("took"))
    upd_rep = touched.join(known, "ref").select(
        F.substring("ref", 3, 1 << 30).alias("id"),
        F.when(F.col("took").isNotNull(), "reopened").when(F.col("status") == "missing", "active").otherwise(F.col("status")).alias("u_status"),
        F.lit(False).alias("u_hit"), F.col("took.sid").alias("u_sid"), F.col("took.url").alias("u_url"))
    upd = upd_set.unionByName(upd_rep)
    reopened_now = F.col("u_status") == "reopened"
    was_reopen = reopened_now & (F.col("status") == "closed")
    Ku = K.join(upd, "id", "left").select(
        *[c for c in ENTITY_COLUMNS if c not in ("status", "last_seen", "updated_at", "url", "source_identifier",
                                                    "classification_reasoning")],
        F.when(F.col("u_hit"), F.when(F.col("status") == "missing", "active").otherwise(F.col("status")))
        .when(F.col("u_status").isNotNull(), F.col("u_status")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("id").isNotNull() & (F.col("u_hit") | F.col("u_status").isNotNull()), now_c)
        .otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.col("u_hit") | F.col("u_status").isNotNull(), now_c).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(was_reopen, F.col("u_url")).otherwise(F.col("url")).alias("url"),
        F.when(was_reopen, F.col("u_sid")).otherwise(F.col("source_identifier")).alias("source_identifier"),
        F.when(
            was_reopen,
            F.concat(F.lit("Job reopened (was closed on "), F.date_format(now_c, "yyyy-MM-dd"),
                     F.lit(", originally first seen "), F.date_format("first_seen", "yyyy-MM-dd"), F.lit(")")),
        ).otherwise(F.col("classification_reasoning")).alias("classification_reasoning"),
    ).select(*ENTITY_COLUMNS)
    entities_out = Ku.unionByName(inserts.select(*ENTITY_COLUMNS))

    observations = dec_rows.select(
        "entity_id", now_c.alias("timestamp"), "batch_seq", "source_identifier", "url",
        F.when(F.col("decision") == "reopened", F.lit("Job reopened")).alias("note"),
    )
    return ClassifyResult(decisions.select(*DECISION_COLUMNS), entities_out, observations)


# ---------------------------------------------------------------------------
# Lifecycle
# ---------------------------------------------------------------------------


def mark_missing(entities: DataFrame, observed_ids: DataFrame, now) -> DataFrame:
    """``active`` records not observed this cycle become ``missing`` (updated_at = now).
    ``reopened`` records are untouched. Observed ids are de-duplicated before the join."""
    now_c = _ts(now)
    seen = observed_ids.select(F.col(observed_ids.columns[0]).alias("id")).distinct().withColumn("_seen", F.lit(True))
    e = entities.join(seen, "id", "left")
    flip = (F.col("status") == "active") & F.col("_seen").isNull()
    return e.withColumn("updated_at", F.when(flip, now_c).otherwise(F.col("updated_at"))).withColumn(
        "status", F.when(flip, F.lit("missing")).otherwise(F.col("status"))
    ).drop("_seen")


def close_old_missing(entities: DataFrame, now, timeout_days: int = DEFAULT_CLOSE_TIMEOUT_DAYS) -> DataFrame:
    """``missing`` and last_seen strictly before now - timeout -> ``closed``."""
    now_c = _ts(now)
    flip = (F.col("status") == "missing") & (F.col("last_seen") < now_c - F.make_dt_interval(F.lit(timeout_days)))
    return entities.withColumn("updated_at", F.when(flip, now_c).otherwise(F.col("updated_at"))).withColumn(
        "status", F.when(flip, F.lit("closed")).otherwise(F.col("status"))
    )


@dataclass
class CycleResult:
    decisions: DataFrame
    entities: DataFrame
    observations: DataFrame
    lifecycle: DataFrame


def run_cycle(entities: DataFrame, batch: DataFrame, now, window_days: int = DEFAULT_WINDOW_DAYS,
              threshold: float = S.DEFAULT_THRESHOLD, close_timeout_days: int = DEFAULT_CLOSE_TIMEOUT_DAYS,
              run_id: str = "run", checkpoint: bool = True) -> CycleResult:
    """Classify all -> mark missing -> close old missing. ``lifecycle`` has one row per
    entity with its status before and after (for A3)."""
    res = classify_batch(entities, batch, now, window_days, threshold, run_id, checkpoint)
    after_classify = _ckpt(res.entities) if checkpoint else res.entities
    marked = mark_missing(after_classify, res.decisions.select("entity_id"), now)
    closed = close_old_missing(marked, now, close_timeout_days)
    lifecycle = after_classify.select("id", F.col("status").alias("status_before")).join(
        closed.select("id", F.col("status").alias("status_after")), "id"
    )
    return CycleResult(res.decisions, closed, res.observations, lifecycle)
