"""Queries over structures and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import refdata
from strandlake.operators import metrics, structure
from strandlake.plans.registry import out, register


def r6(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) AS {name}"


D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
register(
    "st_4_label_binding", lambda t: out(structure.label_binding(t.residues, t.ligands), "structure_id", "idx", "binding"),
    f"SELECT a.structure_id, CAST(a.idx AS BIGINT) AS idx, CAST(CASE WHEN min({D}) <= 6.0 THEN 1 ELSE 0 END AS BIGINT) AS binding FROM $residues a JOIN $ligands b ON a.structure_id = b.structure_id GROUP BY ALL",
)
_SCALES = refdata.values_sql([(aa, *(refdata.residue_scales()[k][aa] for k in ("hydropathy", "charge", "polarity"))) for aa in refdata.RESIDUE_ORDER], "aa, v20, v21, v22")
register(
    "st_5_residue_features", lambda t: out(structure.residue_features(t.residues).select("structure_id", "idx", F.posexplode("features").alias("at", "v"))),
    f"""SELECT structure_id, CAST(idx AS BIGINT) AS idx, at_ AS "at", {r6(f"CASE WHEN at_ < 20 THEN CASE WHEN aa = substr('{refdata.RESIDUE_ORDER}', (at_ + 1)::int, 1) THEN 1 ELSE 0 END WHEN at_ = 20 THEN v20 WHEN at_ = 21 THEN v21 WHEN at_ = 22 THEN v22 WHEN at_ = 26 THEN 0.5 ELSE 0 END", "v")}
        FROM (SELECT *, unnest(range(0, 27)) AS at_ FROM $residues JOIN {_SCALES} USING (aa))""",
)
_W = "OVER (PARTITION BY structure_id ORDER BY idx)"
_LL = "SELECT *, " + ", ".join(f"lag({c}) {_W} AS p{c}, lead({c}) {_W} AS n{c}, lead({c}, 2) {_W} AS m{c}" for c in "xyz") + " FROM $residues"
_U = [f"(p{c} - {c})" for c in "xyz"]
_V = [f"(n{c} - {c})" for c in "xyz"]


def dot(u, v) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"


_SIZE = f"(sqrt({dot(_U, _U)}) * sqrt({dot(_V, _V)}))"
register(
    "st_6_backbone_angles", lambda t: out(structure.backbone_angles(t.residues)),
    f"SELECT structure_id, CAST(idx AS BIGINT) AS idx, {r6(f'coalesce(CASE WHEN {_SIZE} > 0 THEN acos(greatest(-1.0, least(1.0, {dot(_U, _V)} / {_SIZE}))) END, 0)', 'angle')} FROM ({_LL})",
)
_CR = "(ay * ez - az * ey) AS {0}x, (az * ex - ax * ez) AS {0}y, (ax * ey - ay * ex) AS {0}z"
register(
    "st_7_backbone_dihedrals", lambda t: out(structure.backbone_dihedrals(t.residues)),
    f"""WITH b AS (SELECT structure_id, idx, x - px AS ax, y - py AS ay, z - pz AS az, nx - x AS ex, ny - y AS ey, nz - z AS ez, mx - nx AS cx, my - ny AS cy, mz - nz AS cz FROM ({_LL})),
        n AS (SELECT *, {_CR.format("u")}, (ey * cz - ez * cy) AS vx, (ez * cx - ex * cz) AS vy, (ex * cy - ey * cx) AS vz, sqrt(ex * ex + ey * ey + ez * ez) AS lb FROM b),
        l AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS l1, sqrt(vx * vx + vy * vy + vz * vz) AS l2 FROM n)
        SELECT structure_id, CAST(idx AS BIGINT) AS idx, {r6("coalesce(CASE WHEN lb >= 1e-6 AND l1 >= 1e-6 AND l2 >= 1e-6 THEN atan2(((uy * ez - uz * ey) * vx + (uz * ex - ux * ez) * vy + (ux * ey - uy * ex) * vz) / (l1 * lb * l2), (ux * vx + uy * vy + uz * vz) / (l1 * l2)) END, 0)", "dihedral")} FROM l""",
)
PAIRS = f"(SELECT a.structure_id, CAST(a.idx AS BIGINT) AS src, CAST(b.idx AS BIGINT) AS dst, {D} AS d FROM $residues a JOIN $residues b ON a.structure_id = b.structure_id AND a.idx <> b.idx)"
RADIUS = f"(SELECT * FROM {PAIRS} WHERE d > 0 AND d < 8)"
KNN = f"(SELECT structure_id, src, dst, d FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, src ORDER BY d, dst) AS rk FROM {PAIRS}) WHERE rk <= 15)"
EDGES = f"(SELECT * FROM {RADIUS} UNION SELECT * FROM {KNN})"
_E = f"SELECT structure_id, src, dst, {r6('d', 'distance')} FROM "
register("st_8_radius_edges", lambda t: out(structure.radius_edges(t.residues)), _E + RADIUS)
register("st_9_knn_edges", lambda t: out(structure.knn_edges(t.residues)), _E + KNN)
register("st_10_residue_edges", lambda t: out(structure.residue_edges(t.residues)), _E + EDGES)
register(
    "st_11_edge_features", lambda t: structure.edge_feature_values(structure.residue_edges(t.residues, vectors=True), t.residues, 6).withColumns({c: F.col(c).cast("long") for c in ("src", "dst", "at")}),
    f"""SELECT structure_id, src, dst, at_ AS "at", {r6("CASE WHEN at_ = 0 THEN d WHEN at_ = 17 THEN dx / (d + 1e-8) WHEN at_ = 18 THEN dy / (d + 1e-8) WHEN at_ = 19 THEN dz / (d + 1e-8) WHEN d >= (at_ - 1) * 1.25 AND (d < at_ * 1.25 OR (at_ = 16 AND d <= 20)) THEN 1 ELSE 0 END", "v")}
        FROM (SELECT e.*, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, unnest(range(0, 20)) AS at_ FROM {EDGES} e JOIN $residues a ON a.structure_id = e.structure_id AND a.idx = src JOIN $residues b ON b.structure_id = e.structure_id AND b.idx = dst)""",
)
register(
    "st_12_sequential_edges", lambda t: out(structure.sequential_edges(t.residues, 2)),
    """SELECT structure_id, CASE WHEN k = 0 THEN i ELSE i + s END AS src, CASE WHEN k = 0 THEN i + s ELSE i END AS dst FROM (SELECT structure_id, CAST(idx AS BIGINT) AS i, s, unnest([0, 1]) AS k FROM (
        SELECT *, unnest([1, 2]) AS s FROM (SELECT *, count(*) OVER (PARTITION BY structure_id) AS n FROM $residues) WHERE idx < n - 2))""",
)
register(
    "st_13_graph_stats", lambda t: out(structure.graph_stats(t.residues, structure.radius_edges(t.residues))),
    f"SELECT r.structure_id, nodes, coalesce(e.edges, 0) AS edges, {r6('coalesce(e.edges, 0) * 1.0 / nodes', 'mean_degree')} FROM (SELECT structure_id, count(*) AS nodes FROM $residues GROUP BY ALL) r LEFT JOIN (SELECT structure_id, count(*) AS edges FROM {RADIUS} GROUP BY ALL) e USING (structure_id)",
)
register(
    "st_14_neighbor_pool", lambda t: out(structure.neighbor_pool(t.residues.select("structure_id", "idx", F.array("x", "y", "z").alias("features")), structure.radius_edges(t.residues))),
    f"""SELECT e.structure_id, src AS idx, at_ AS "at", {r6("avg(v)", "mean")}, {r6("max(v)", "max")} FROM (SELECT e.*, at_, CASE at_ WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM (SELECT *, unnest(range(0, 3)) AS at_ FROM {RADIUS}) e JOIN $residues r ON r.structure_id = e.structure_id AND r.idx = e.dst) e GROUP BY ALL""",
)

# ---- predictions
register("mt_1_top_sites", lambda t: out(metrics.top_sites(t.scores, 0.5, 10)), f"SELECT grp, id, {r6('y_proba', 'y_proba')}, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY y_proba DESC, id) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS total FROM $scores) WHERE y_proba >= 0.5) WHERE rank <= 10")
register(
    "mt_2_pocket_clusters", lambda t: out(metrics.pocket_clusters(t.residues)),
    """SELECT structure_id, CAST(pocket AS BIGINT) AS pocket, chain, count(*) AS size, CAST(min(resi) AS BIGINT) AS first, CAST(max(resi) AS BIGINT) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY structure_id ORDER BY resi, chain) AS pocket FROM (
        SELECT *, CASE WHEN resi - lag(resi) OVER (PARTITION BY structure_id ORDER BY resi, chain) <= 6 THEN 0 ELSE 1 END AS new FROM $residues)) GROUP BY ALL""",
)
register("mt_3_confidence_scale", lambda t: out(metrics.confidence_scale(t.scores)), f"SELECT grp, id, {r6('(y_proba - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 0.01 END', 'scaled')} FROM (SELECT *, min(y_proba) OVER (PARTITION BY grp) AS lo, max(y_proba) OVER (PARTITION BY grp) AS hi FROM $scores)")


def safe(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) * 1.0 / ({b}) ELSE 0 END"


_P, _R, _S = safe("tp", "tp + fp"), safe("tp", "tp + fn"), safe("tn", "tn + fp")
RATES = (
    f"{r6(safe('tp + tn', 'tp + fp + tn + fn'), 'accuracy')}, {r6(_P, 'precision')}, {r6(_R, 'recall')}, {r6(f'CASE WHEN tp > 0 THEN 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) ELSE 0 END', 'f1')}, "
    f"{r6('CASE WHEN (tp + fp) > 0 AND (tp + fn) > 0 AND (tn + fp) > 0 AND (tn + fn) > 0 THEN (tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)) ELSE 0 END', 'mcc')}, {r6(_S, 'specificity')}, {r6(f'(({_R}) + ({_S})) / 2', 'balanced_accuracy')}"
)
COUNTS = "count(*) FILTER (y_proba >= {t} AND y_true = 1) AS tp, count(*) FILTER (y_proba >= {t} AND y_true = 0) AS fp, count(*) FILTER (y_proba < {t} AND y_true = 0) AS tn, count(*) FILTER (y_proba < {t} AND y_true = 1) AS fn"
register("mt_4_classification_metrics", lambda t: out(metrics.classification_metrics(t.scores, 0.5, "grp")), f"SELECT grp, tp, fp, tn, fn, {RATES} FROM (SELECT grp, {COUNTS.format(t='0.5')} FROM $scores GROUP BY grp)")
BY = """(SELECT *, sum(pos) OVER (ORDER BY y_proba DESC) AS tp, sum(neg) OVER (ORDER BY y_proba DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM (
    SELECT y_proba, CAST(sum(y_true) AS DOUBLE) AS pos, CAST(sum(1 - y_true) AS DOUBLE) AS neg FROM $scores GROUP BY y_proba))"""
register("mt_5_roc_curve", lambda t: out(metrics.roc_curve(t.scores)), f"SELECT {r6('y_proba', 'threshold')}, {r6(safe('fp', 'nn'), 'fpr')}, {r6(safe('tp', 'np'), 'tpr')} FROM {BY} UNION ALL SELECT NULL, 0, 0")
AUC = f"(SELECT {r6('sum(pos * (nn - fp + neg / 2)) / (max(np) * max(nn))', 'roc_auc')} FROM {BY})"
AP = f"(SELECT {r6('sum(pos * tp / (tp + fp)) / max(np)', 'average_precision')} FROM {BY})"
register("mt_6_roc_auc", lambda t: out(metrics.roc_auc(t.scores)), f"SELECT * FROM {AUC}")
PR = f"(SELECT y_proba AS threshold, tp / (tp + fp) AS p, {safe('tp', 'np')} AS r FROM {BY} UNION ALL SELECT NULL, 1, 0)"
register("mt_7_pr_curve", lambda t: out(metrics.pr_curve(t.scores)), f"SELECT {r6('threshold', 'threshold')}, {r6('p', 'precision')}, {r6('r', 'recall')} FROM {PR}")
register("mt_8_average_precision", lambda t: out(metrics.average_precision(t.scores)), f"SELECT * FROM {AP}")
BEST = f"(SELECT coalesce(threshold, 0.5) AS threshold, f1 FROM (SELECT *, 2 * p * r / (p + r + 1e-8) AS f1 FROM {PR}) ORDER BY f1 DESC, coalesce(threshold, 0.5) LIMIT 1)"
register("mt_9_best_threshold", lambda t: out(metrics.best_threshold(t.scores)), f"SELECT {r6('threshold', 'threshold')}, {r6('f1', 'f1')} FROM {BEST}")
register(
    "mt_10_topk_accuracy", lambda t: out(metrics.topk_accuracy(t.scores)),
    f"SELECT grp, {r6('CASE WHEN sum(y_true) > 0 THEN count(*) FILTER (rank <= 10 AND y_true = 1) * 1.0 / least(sum(y_true), 10) ELSE 0 END', 'topk')} FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY y_proba DESC, id DESC) AS rank FROM $scores) GROUP BY grp",
)
_PLACES = lambda t: t.scores.join(t.residues.select("structure_id", F.col("resi").cast("long").alias("id"), "x", "y", "z"), "id")
_PSQL = "(SELECT s.id, y_true, y_proba, structure_id, x, y, z FROM $scores s JOIN $residues r ON r.resi = s.id)"
register(
    "mt_11_distance_to_center", lambda t: out(metrics.distance_to_center(_PLACES(t).where("y_proba >= 0.55"), _PLACES(t).where("y_true = 1"))),
    f"""SELECT structure_id, {r6("coalesce(avg(d), 'inf'::DOUBLE)", "mean")}, {r6("coalesce(avg(CASE WHEN d <= 4 THEN 1.0 WHEN d > 4 THEN 0.0 END), 0)", "within")} FROM (SELECT structure_id FROM {_PSQL} WHERE y_proba >= 0.55 UNION SELECT structure_id FROM {_PSQL} WHERE y_true = 1)
        LEFT JOIN (SELECT a.structure_id, a.id, min({D}) AS d FROM {_PSQL} a JOIN {_PSQL} b ON a.structure_id = b.structure_id WHERE a.y_proba >= 0.55 AND b.y_true = 1 GROUP BY ALL) USING (structure_id) GROUP BY structure_id""",
)
register(
    "mt_12_site_coverage", lambda t: out(metrics.site_coverage(_PLACES(t).where("y_proba >= 0.55"), _PLACES(t).where("y_true = 1"))),
    f"SELECT structure_id, {r6('avg(CASE WHEN y_proba >= 0.55 THEN 1.0 ELSE 0 END)', 'coverage')} FROM {_PSQL} WHERE y_true = 1 GROUP BY ALL",
)
_FOLDS = lambda t: metrics.classification_metrics(t.scores, 0.5, "fold").unpivot("fold", ["accuracy", "f1", "mcc"], "metric", "value")
register(
    "mt_13_cross_validation_summary", lambda t: out(metrics.cross_validation_summary(_FOLDS(t))),
    f"""WITH m AS (SELECT fold, {RATES.replace("round(", "(").replace(", 6)", ")")} FROM (SELECT fold, {COUNTS.format(t="0.5")} FROM $scores GROUP BY fold)), u AS (SELECT 'accuracy' AS metric, accuracy AS v FROM m UNION ALL SELECT 'f1', f1 FROM m UNION ALL SELECT 'mcc', mcc FROM m)
        SELECT metric, {r6("avg(v)", "mean")}, {r6("stddev_pop(v)", "std")}, {r6("min(v)", "min")}, {r6("max(v)", "max")} FROM u GROUP BY metric""",
)
register(
    "mt_14_evaluate", lambda t: out(metrics.evaluate(t.scores)),
    f"SELECT {r6('threshold', 'threshold')}, tp, fp, tn, fn, {RATES}, roc_auc, average_precision FROM (SELECT threshold, {COUNTS.format(t='threshold')} FROM $scores CROSS JOIN (SELECT threshold FROM {BEST}) GROUP BY threshold) CROSS JOIN {AUC} CROSS JOIN {AP}",
)
_SOFT = "(ln(1 + exp(-abs(logit))) + greatest(-logit, 0))"
register(
    "mt_15_loss_report", lambda t: out(metrics.loss_report(t.logits)),
    f"""SELECT {r6("bce", "bce")}, {r6("focal", "focal")}, {r6("1 - (2 * i + 1) / (sp + sy + 1)", "dice")}, {r6("1 - (i + 1) / (i + 0.3 * (sp - i) + 0.7 * (sy - i) + 1)", "tversky")}, {r6("0.3 * bce + 0.7 * (1 - (2 * i + 1) / (sp + sy + 1))", "combined")} FROM (
        SELECT avg((1 - y_true) * logit + (1 + 4 * y_true) * {_SOFT}) AS bce, avg(0.25 * power(1 - CASE WHEN y_true = 1 THEN p ELSE 1 - p END, 2) * ((1 - y_true) * logit + {_SOFT})) AS focal, sum(p * y_true) AS i, sum(p) AS sp, sum(y_true) AS sy FROM (SELECT *, 1 / (1 + exp(-logit)) AS p FROM $logits))""",
)
register("mt_16_split_dataset", lambda t: out(metrics.split_dataset(t.scores, "id"), "id", "part"), "SELECT id, CASE WHEN id % 10 < 8 THEN 'train' WHEN id % 10 < 9 THEN 'validation' ELSE 'test' END AS part FROM $scores")
