"""The operators that can be called by name, with what each needs and makes.

Inputs are views of a session: ``atoms`` (see schemas.ATOMS), ``features`` (traj_id,
frame, time_ps and numbers), ``segments``, ``clusters`` and so on, as the operators
before have made them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import groups as G
from ..operators import aggregates, attribution, clustering, geometry, joins, scoring, statistics, windows
from ..schemas import numeric_columns
from ..sources import sinks, tables, trajectories
from . import features as feature_tables
from . import guests, metastable, rescoring, states, structures
from .passes import standard
from .pipeline import Analysis
from .registry import Parameter, Registry, Session

REGISTRY = Registry()
P = Parameter


def op(name: str, requires: tuple = (), produces: tuple = (), parameters: tuple = (), category: str = "analysis"):
    return REGISTRY.operator(name, "", parameters, requires, produces, category)


def _columns(s: Session, names) -> list[str]:
    return list(names) if names else numeric_columns(s.values["features"])


def _groups(s: Session, names) -> dict[str, list[str]]:
    found = G.group_map(s.values["features"], list(names) if names else None)
    return found or {"combined": numeric_columns(s.values["features"])}


def _where(condition: str | None):
    return F.expr(condition) if condition else F.lit(True)


SELECTION = P("selection", "string", "SQL condition on atoms")
WINDOW = (P("window", "integer", "rows of a window", 50), P("rel", "number", "share of the deviation", 0.12))

# ---- loading


@op("load_trajectory", (), ("atoms", "residue_catalog", "main_species"), (P("path", required=True), P("format", choices=("pdb", "xyz", "parquet"), default="pdb")), "trajectory")
def load_trajectory(s, path, format):
    """Read a trajectory as a long atom table, with its residues and main species."""
    if format == "xyz":
        return {"atoms": trajectories.centroid_of(trajectories.read_xyz(s.spark, path))}
    atoms = trajectories.read_pdb(s.spark, path) if format == "pdb" else s.spark.read.parquet(path)
    return {"atoms": atoms, "residue_catalog": aggregates.residue_catalog(atoms), "main_species": aggregates.main_species(atoms)}


@op("set_main_selection", ("atoms",), ("atoms",), (P("selection", required=True),), "trajectory")
def set_main_selection(s, selection):
    """Keep only the atoms that a condition selects."""
    return {"atoms": s.values["atoms"].where(selection)}


@op("load_features", (), ("features",), (P("path", required=True), P("schema"), P("format", default="csv")), "trajectory")
def load_features(s, path, schema, format):
    """Read per-frame feature tables."""
    return {"features": tables.read_features(s.spark, path, schema, format)}


@op("export_frames", ("atoms",), (), (P("folder", required=True), P("frames", "array")), "fileio")
def export_frames(s, folder, frames):
    """Write frames as PDB records, a folder each."""
    atoms = s.values["atoms"]
    sinks.write_pdb(atoms.where(F.col("frame").isin(list(frames))) if frames else atoms, folder)
    return {}


# ---- metrics


@op("run_trajectory_observer_pass", ("atoms",), ("observer_pass_results",), (P("metrics", "array"), SELECTION, P("start", "integer"), P("stop", "integer"), P("step", "integer", default=1)), "trajectory")
def observer_pass(s, metrics, selection, start, stop, step):
    """Any number of per-frame metrics in one aggregation."""
    m = standard()
    names = list(metrics) if metrics else m.defaults()
    picked = {n: _where(selection) for n in names} if selection else None
    return {"observer_pass_results": m.run(s.values["atoms"], names, picked, frames=(start, stop, step))}


@op("compute_rg", ("atoms",), ("rg",), (SELECTION,), "metrics")
def compute_rg(s, selection):
    """Radius of gyration per frame."""
    return {"rg": geometry.centroids(s.values["atoms"].where(_where(selection)), []).select("traj_id", "frame", "rg")}


@op("compute_rmsd", ("atoms",), ("rmsd",), (SELECTION, P("ref_frame", "integer", default=0)), "metrics")
def compute_rmsd(s, selection, ref_frame):
    """Distance of each frame from a reference frame after superposition."""
    pos = geometry.positions(s.values["atoms"].where(_where(selection)))
    ref = pos.where(F.col("frame") == ref_frame).select("traj_id", "positions", "atom_ids")
    return {"rmsd": geometry.rmsd_to_reference(pos, ref).select("traj_id", "frame", "rmsd")}


@op("align", ("atoms",), ("atoms",), (SELECTION, P("ref_frame", "integer", default=0)), "metrics")
def align(s, selection, ref_frame):
    """Superpose all frames on a reference frame by a selection."""
    return {"atoms": geometry.align(s.values["atoms"], _where(selection), ref_frame)}


@op("compute_rmsf", ("atoms",), ("rmsf",), (SELECTION,), "metrics")
def compute_rmsf(s, selection):
    """Fluctuation of each atom."""
    return {"rmsf": aggregates.atom_fluctuation(s.values["atoms"].where(_where(selection)))}


@op("compute_pca", ("atoms",), ("pca_scores",), (SELECTION, P("components", "integer", default=5)), "metrics")
def compute_pca(s, selection, components):
    """Principal components of the coordinates."""
    pos = geometry.positions(s.values["atoms"].where(_where(selection))).withColumn("flat", F.flatten("positions"))
    scores, share = clustering.pca(pos, "flat", components)
    return {"pca_scores": scores.select("traj_id", "frame", "pcs"), "pca_variance_explained": share}


@op("compute_contacts", ("atoms",), ("contacts",), (P("group", default="resid"), P("cutoff", "number", default=4.5)), "metrics")
def compute_contacts(s, group, cutoff):
    """Contacts between groups of atoms, pair by pair."""
    return {"contacts": geometry.contacts(s.values["atoms"], group, float(cutoff))}


@op("contact_graph", ("atoms",), ("contact_summary",), (P("group", default="resid"), P("cutoff", "number", default=4.5)), "metrics")
def contact_graph(s, group, cutoff):
    """Interfaces, density and the largest connected part of the contact graph."""
    return {"contact_summary": geometry.contact_summary(s.values["atoms"], group, float(cutoff))}


@op("compute_strain", ("atoms",), ("strain",), (SELECTION, P("window", "integer", default=10), P("lag", "integer", default=1)), "metrics")
def compute_strain(s, selection, window, lag):
    """Local affine strain."""
    return {"strain": geometry.strain(geometry.positions(s.values["atoms"].where(_where(selection))), window, lag)}


@op("compute_volume", ("atoms",), ("volume",), (SELECTION, P("spacing", "number", default=0.5), P("gaussian", "boolean", default=False)), "volume")
def compute_volume(s, selection, spacing, gaussian):
    """Occupied and cavity volume on a grid."""
    return {"volume": geometry.cavity_volume(s.values["atoms"].where(_where(selection)), float(spacing), gaussian=gaussian)}


@op("compute_cube_metrics", ("atoms",), ("cube_metrics",), (P("group", default="resid"),), "cage")
def cube_metrics(s, group):
    """Shape of the whole, planes and centres of its groups, and how regular these stand."""
    atoms = s.values["atoms"]
    centres = geometry.centroids(atoms, [group])
    return {"cube_metrics": geometry.shapes(atoms).join(geometry.neighbour_statistics(centres.select("traj_id", "frame", group, "x", "y", "z"), group).drop("mean", "std"), ["traj_id", "frame"], "left").join(geometry.opposite_distances(centres, group), ["traj_id", "frame"], "left")}


@op("compute_cage_features", ("atoms",), ("features",), (P("group", default="resid"), P("cutoff", "number", default=4.5)), "changepoint")
def cage_features(s, group, cutoff):
    """A feature table from atoms: shape, regularity and contacts per frame."""
    atoms = s.values["atoms"]
    shape = geometry.shapes(atoms)
    shape = shape.withColumnsRenamed({c: f"assembly_{c}" for c in shape.columns if c not in ("traj_id", "frame")})
    centres = geometry.centroids(atoms, [group]).select("traj_id", "frame", group, "x", "y", "z")
    near = geometry.neighbour_statistics(centres, group)
    near = near.withColumnsRenamed({c: f"com_{c}" for c in near.columns if c not in ("traj_id", "frame")})
    times = atoms.groupBy("traj_id", "frame").agg(F.min("time_ps").alias("time_ps"))
    out = times
    for part in (shape, near, geometry.contact_summary(atoms, group, float(cutoff))):
        out = out.join(part, ["traj_id", "frame"], "left")
    return {"features": out}


@op("compute_gsa_features", ("atoms",), ("features",), (P("group", default="resid"), P("main"), P("guest"), P("solvent"), P("head"), P("tail"), P("cutoff", "number", default=4.5), P("cavity", "number", default=8.0)), "changepoint")
def gsa_features(s, group, main, guest, solvent, head, tail, cutoff, cavity):
    """A feature table from atoms with every tier whose atoms are named by a condition."""
    at = {k: F.expr(v) if v else None for k, v in (("main", main), ("guest", guest), ("solvent", solvent), ("head", head), ("tail", tail))}
    return {"features": feature_tables.assembly_features(s.values["atoms"], group, cutoff=float(cutoff), cavity=float(cavity), **at)}


@op("compute_murata_motif_rmsd", ("atoms", "motifs", "motif_units"), ("motif_rmsd",), (P("ref_frame", "integer", default=0),), "changepoint")
def motif_rmsd(s, ref_frame):
    """Distances and superposed RMSD of motifs, frame by frame."""
    return {"motif_rmsd": feature_tables.motif_rmsd(s.values["atoms"], s.values["motifs"], s.values["motif_units"], ref_frame)}


@op("find_endpoints", ("atoms",), ("endpoints",), (P("group", default="resid"),), "endpoints")
def find_endpoints(s, group):
    """The atoms of each group farthest from its centre in the first frame: its ends."""
    atoms = s.values["atoms"].where("frame = 0")
    c = atoms.groupBy("traj_id", group).agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    d = sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    far = aggregates.top_k(atoms.join(c, ["traj_id", group]).withColumn("d", F.sqrt(d)), ["traj_id", group], [F.desc("d"), F.col("atom_id")], 2, "site_index")
    return {"endpoints": far.select("traj_id", F.col(group).alias("monomer"), "site_index", "atom_id")}


@op("compute_endpoint_distances", ("atoms", "endpoints"), ("endpoint_distances",), (), "endpoints")
def endpoint_distances(s):
    """Distances between the ends of different groups, frame by frame."""
    ends = s.values["atoms"].join(s.values["endpoints"], ["traj_id", "atom_id"]).select("traj_id", "frame", "monomer", "site_index", "x", "y", "z")
    b = ends.select(*(F.col(c).alias(f"b_{c}") for c in ends.columns))
    on = (F.col("traj_id") == F.col("b_traj_id")) & (F.col("frame") == F.col("b_frame")) & (F.col("monomer") < F.col("b_monomer"))
    d = F.sqrt(sum(((F.col(a) - F.col(f"b_{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    out = ends.join(b, on).select("traj_id", "frame", F.col("monomer").alias("mon_i"), F.col("site_index").alias("site_a"), F.col("b_monomer").alias("mon_j"), F.col("b_site_index").alias("site_b"), d.alias("dist"))
    return {"endpoint_distances": out, "endpoint_levels": aggregates.pair_and_frame_levels(out, ["traj_id", "frame"], ["mon_i", "mon_j"], "dist")}


@op("endpoint_volume_correlation", ("endpoint_distances", "volume"), ("correlation",), (), "endpoints")
def endpoint_volume_correlation(s):
    """Correlation of every pair's distance with the volume."""
    met = s.values["endpoint_distances"].join(s.values["volume"].select("traj_id", "frame", "volume"), ["traj_id", "frame"])
    return {"correlation": statistics.correlations(met, "dist", "volume", ["mon_i", "site_a", "mon_j", "site_b"])}


@op("compute_layered_interactions", ("endpoint_distances",), ("interface_stability",), (P("cutoff", "number", default=4.5),), "endpoints")
def layered_interactions(s, cutoff):
    """Per pair of groups how long contacts last."""
    near = s.values["endpoint_distances"].groupBy("traj_id", "mon_i", "mon_j", "frame").agg((F.min("dist") < float(cutoff)).alias("on"))
    return {"interface_stability": windows.run_statistics(near, ["traj_id", "mon_i", "mon_j"], "frame", "on")}


# ---- sequences


@op("detect_motion_plateau", ("features",), ("plateau",), (P("metric", required=True), *WINDOW), "metrics")
def motion_plateau(s, metric, window, rel):
    """Where a metric settles, series by series."""
    return {"plateau": windows.plateau(s.values["features"], "traj_id", "frame", metric, window, float(rel))}


@op("track_guest", ("features",), ("guest_stats", "guest_events"), (P("guest", default="n_guest_inside_cavity"), P("min_dwell", "integer", default=20)), "guest")
def track_guest(s, guest, min_dwell):
    """Entries, exits and stays of guests."""
    return {"guest_stats": guests.residence(s.values["features"], guest), "guest_events": guests.events(s.values["features"], guest, min_dwell=min_dwell)}


@op("compare_guest_cage_geometry", ("features",), ("guest_cage_geometry",), (P("guest", default="n_guest_inside_cavity"), P("columns", "array")), "changepoint")
def guest_geometry(s, guest, columns):
    """What differs with a guest inside."""
    df = s.values["features"]
    df = df if "cohort" in df.columns else df.withColumn("cohort", F.lit("all"))
    cols = [c for c in _columns(s, columns) if c != guest]
    return {"guest_cage_geometry": guests.geometry_contrast(df.fillna("all", ["cohort"]), guest, cols)}


@op("guest_entry_geometry_response", ("features", "guest_events"), ("guest_entry_response",), (P("columns", "array"), P("window", "integer", default=100)), "changepoint")
def guest_response(s, columns, window):
    """What changes around entries."""
    return {"guest_entry_response": guests.entry_response(s.values["features"], s.values["guest_events"].where("event = 'entry'"), _columns(s, columns), window=window)}


@op("guest_event_cotiming", ("features", "guest_events", "breakpoints"), ("guest_event_cotiming",), (P("tolerance", "integer", default=50),), "changepoint")
def guest_cotiming(s, tolerance):
    """How often breakpoints accompany entries."""
    n = s.values["features"].groupBy("traj_id").agg(F.count("*").alias("n"))
    return {"guest_event_cotiming": guests.cotiming(s.values["guest_events"].where("event = 'entry'"), s.values["breakpoints"], n, tolerance=tolerance)}


# ---- changepoints and clusters

DETECTION = (P("groups", "array"), P("method", default="pelt", choices=("pelt", "binseg", "bottomup", "window", "dynp", "kernelcpd")), P("cost", default="rbf", choices=("l1", "l2", "rbf", "normal", "linear", "ar", "rank", "mahalanobis")), P("penalty", "number"), P("min_size", "integer", default=2), P("jump", "integer", default=5), P("tolerance", "integer", default=50), P("k", "integer"))


def _analysis(s: Session, groups, method, cost, penalty, min_size, jump, tolerance, k) -> Analysis:
    return Analysis(s.values["features"], _groups(s, groups), method, cost, penalty, min_size, jump, tolerance, k)


@op("detect_changepoints", ("features",), ("breakpoints",), DETECTION, "metrics")
def detect_changepoints(s, **options):
    """Breakpoints of every series and feature group."""
    return {"breakpoints": _analysis(s, **options).breakpoints()}


@op("changepoint_feature_groups", ("features",), ("breakpoints", "segments"), DETECTION, "changepoint")
def changepoint_groups(s, **options):
    """Breakpoints and segments of every feature group."""
    a = _analysis(s, **options)
    return {"breakpoints": a.breakpoints(), "segments": a.segments()}


@op("sweep_changepoint_penalty", ("features",), ("penalty_sweep", "penalty"), (*DETECTION, P("points", "integer", default=12)), "changepoint")
def sweep_penalty(s, points, **options):
    """Breakpoints over a grid of penalties, and the elbow."""
    a = _analysis(s, **options)
    return {"penalty_sweep": a.sweep(points), "penalty": a.pick(points)}


@op("compare_changepoint_timing", ("breakpoints",), ("timing", "timing_summary"), (P("tolerance", "integer", default=50),), "changepoint")
def changepoint_timing(s, tolerance):
    """Agreement of groups' breakpoints."""
    bp = s.values["breakpoints"]
    timing = joins.compare_timing(bp, bp.select("traj_id", "grp").distinct(), tolerance)
    return {"timing": timing, "timing_summary": aggregates.cohort_summary(timing)}


@op("cluster_changepoint_segments", ("features", "segments"), ("clusters",), (P("k", "integer"), P("method", default="ward", choices=("ward", "average", "complete", "weighted", "single"))), "changepoint")
def cluster_segments(s, k, method):
    """Segments clustered by their means and deviations."""
    seg = s.values["segments"]
    cols = [c for c in seg.columns if c.endswith(("_mean", "_std"))]
    matrix = clustering.feature_matrix(seg, cols, ["grp"])
    labels = clustering.ward(matrix, ["traj_id", "segment_id"], ["grp"], method, k)
    cuts = clustering.cuts(matrix, ["traj_id", "segment_id"], ["grp"], method)
    return {"clusters": seg.join(labels, ["grp", "traj_id", "segment_id"]), "segment_matrix": matrix, "segment_cuts": cuts}


@op("run_changepoint_pipeline", ("features",), ("breakpoints", "segments", "clusters", "transitions"), (*DETECTION, P("sweep", "boolean", default=False)), "changepoint")
def changepoint_pipeline(s, sweep, **options):
    """Detection, segments, clusters, transitions and the cohort's summary."""
    return _analysis(s, **options).run(sweep)


@op("summarize_changepoint_results", ("breakpoints", "clusters"), ("population", "lifetimes", "state_paths"), (), "changepoint")
def summarize_changepoints(s):
    """Populations, lifetimes and paths of clusters."""
    c = s.values["clusters"]
    return {"population": aggregates.cluster_population(c, by=["grp"]), "lifetimes": aggregates.cluster_lifetime(c), "state_paths": windows.state_paths(c, ["traj_id", "grp"], "start_frame", "cluster_label")}


@op("attribute_endpoint_transitions", ("features", "clusters"), ("transition_ranking",), (P("grp", required=True), P("columns", "array"), P("window", "integer")), "changepoint")
def attribute_transitions(s, grp, columns, window):
    """Which features tell what changes at handoffs."""
    moves = windows.handoffs(s.values["clusters"].where(F.col("grp") == grp))
    return {"transition_ranking": attribution.transition_scores(moves, s.values["features"], _columns(s, columns), window=window)}


@op("audit_cluster_replicas", ("clusters",), ("replica_audit",), (P("most", "number", default=0.5),), "changepoint")
def audit_replicas(s, most):
    """Clusters that one series dominates."""
    return {"replica_audit": structures.replica_audit(s.values["clusters"], most=float(most))}


@op("detect_replica_outliers", ("features", "clusters"), ("replica_outliers",), (P("value", required=True),), "changepoint")
def replica_outliers(s, value):
    """Isolated clusters that depart from the rest of their series."""
    return {"replica_outliers": structures.outliers(s.values["features"], s.values["clusters"], value)}


@op("rank_endpoint_pairs_at_k", ("clusters",), ("pair_ranking",), (P("grp", required=True),), "changepoint")
def rank_pairs(s, grp):
    """Features by how far they tell clusters apart."""
    c = s.values["clusters"].where(F.col("grp") == grp)
    cols = [x for x in c.columns if x.endswith("_mean")]
    long = c.unpivot(["traj_id", "cluster_label"], cols, "feature", "value")
    return {"pair_ranking": statistics.rank_features(statistics.eta_squared(long, "value", "cluster_label"), statistics.kruskal_epsilon(long, "value", "cluster_label").drop("h"))}


@op("scan_endpoint_cluster_chemical_k", ("segments", "segment_cuts"), ("chemical_scan",), (P("grp", required=True),), "changepoint")
def chemical_scan(s, grp):
    """For every k whether contacts tell clusters apart."""
    seg = s.values["segments"].where(F.col("grp") == grp)
    return {"chemical_scan": structures.chemical_scan(seg, s.values["segment_cuts"].where(F.col("grp") == grp).drop("grp"), [c for c in seg.columns if c.endswith("_mean")])}


@op("select_physical_k", ("features", "segments", "segment_cuts", "chemical_scan"), ("physical_scan", "k_selected"), (P("grp", required=True), P("columns", "array", required=True), P("draws", "integer", default=500)), "changepoint")
def physical_k(s, grp, columns, draws):
    """The smallest k whose clusters predict geometry that did not make them."""
    seg = s.values["segments"].where(F.col("grp") == grp)
    labelled = structures.frames_by_cut(s.values["features"], seg, s.values["segment_cuts"].where(F.col("grp") == grp).drop("grp"))
    scan = structures.physical_scan(labelled, list(columns), n=draws)
    return {"physical_scan": scan, "k_selected": structures.select_k(s.values["chemical_scan"], scan)}


@op("validate_endpoint_clusters", ("clusters", "segment_matrix"), ("cluster_validation", "cluster_diameters", "profile_correlations"), (P("splits", "integer", default=5), P("repeats", "integer", default=20)), "changepoint")
def validate_clusters(s, splits, repeats):
    """Hold-out accuracy, diameters and profile correlations."""
    m = s.values["segment_matrix"].select("grp", "traj_id", "segment_id", "x").join(s.values["clusters"].select("grp", "traj_id", "segment_id", "cluster_label"), ["grp", "traj_id", "segment_id"])
    return {"cluster_validation": clustering.hold_out(m, ["grp"], "cluster_label", "traj_id", splits, repeats), "cluster_diameters": clustering.diameters(m, ["traj_id", "segment_id"], ["grp"]), "profile_correlations": clustering.profile_correlations(m, ["grp"])}


@op("check_merge_dilution", ("clusters", "segment_matrix"), ("merge_dilution",), (), "changepoint")
def merge_dilution(s):
    """Profile correlations of clusters as wholes and of their cores."""
    m = s.values["segment_matrix"].select("grp", "traj_id", "segment_id", "x").join(s.values["clusters"].select("grp", "traj_id", "segment_id", "cluster_label"), ["grp", "traj_id", "segment_id"])
    core = clustering.core_split(m, ["grp"], ["traj_id", "segment_id"])
    whole = clustering.profile_correlations(m, ["grp"])
    kept = clustering.profile_correlations(m.join(core.where("core").drop("core", "cluster_label"), ["grp", "traj_id", "segment_id"]), ["grp"])
    return {"merge_dilution": whole.join(kept.select("grp", "a", "b", F.col("best_r").alias("core_r")), ["grp", "a", "b"], "left")}


@op("bootstrap_core_match", ("clusters", "segment_matrix"), ("core_bootstrap",), (P("grp", required=True), P("a", "integer", required=True), P("b", "integer", required=True), P("draws", "integer", default=200)), "changepoint")
def core_bootstrap(s, grp, a, b, draws):
    """How sure the likeness of two clusters is, over resampled series."""
    m = s.values["segment_matrix"].where(F.col("grp") == grp).join(s.values["clusters"].select("grp", "traj_id", "segment_id", "cluster_label"), ["grp", "traj_id", "segment_id"])
    return {"core_bootstrap": structures.core_match(m, "cluster_label", a, b, "traj_id", draws)}


@op("categorize_cluster_mixtures", ("labelled_frames",), ("cluster_mixtures",), (P("label", default="cluster_label"), P("category", required=True)), "changepoint")
def cluster_mixtures(s, label, category):
    """Clusters that hold more than one category of frames."""
    return {"cluster_mixtures": structures.mixtures(s.values["labelled_frames"], label, category)}


@op("label_frames", ("features", "clusters"), ("labelled_frames",), (P("grp", required=True),), "changepoint")
def label_frames(s, grp):
    """Frames with the cluster of the segment they lie in."""
    seg = s.values["clusters"].where(F.col("grp") == grp).select("traj_id", "cluster_label", "start_frame", "end_frame")
    return {"labelled_frames": joins.label_points(s.values["features"], seg, ["traj_id"], "frame")}


@op("describe_endpoint_clusters", ("labelled_frames",), ("cluster_profiles",), (P("structure", required=True), P("edges", "array", required=True), P("poles", "array", required=True)), "changepoint")
def describe_clusters(s, structure, edges, poles):
    """Motif profiles of clusters, with names."""
    return {"cluster_profiles": structures.profiles(s.values["labelled_frames"], "cluster_label", structure, list(edges), list(poles))}


@op("compare_metastructures", ("labelled_frames",), ("structure_occupancy",), (P("structure", required=True),), "changepoint")
def structure_occupancy(s, structure):
    """Percent of frames with each metastructure label."""
    names = s.spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in ("A", "B", "C1", "C2", "other")))).alias("label"))
    return {"structure_occupancy": aggregates.occupancy(s.values["labelled_frames"], structure, names)}


@op("assembly_qc", ("features",), ("qc", "features"), (P("spread", required=True), P("component", required=True), P("most", "number", required=True), P("least", "number", required=True)), "changepoint")
def assembly_qc(s, spread, component, most, least):
    """Series that fell apart, and the features without them."""
    qc = aggregates.quality(s.values["features"], spread, component, float(most), float(least))
    return {"qc": qc, "features": joins.without_series(s.values["features"], qc.where("failed"))}


COHORT = P("by", "array", "columns that tell cohorts apart")


@op("select_chemical_k", ("chemical_scan",), ("chemical_k_selected",), (), "changepoint")
def chemical_k(s):
    """The k that chemistry tells apart best."""
    return {"chemical_k_selected": metastable.select_chemical_k(s.values["chemical_scan"])}


@op("rank_metastable_structures", ("labelled_frames", "clusters"), ("structure_ranking",), (P("grp", required=True),), "changepoint")
def rank_structures(s, grp):
    """Structures by their share of frames."""
    return {"structure_ranking": metastable.rank_structures(s.values["labelled_frames"], s.values["clusters"].where(F.col("grp") == grp))}


@op("summarize_metastable_structures", ("structure_ranking", "cluster_profiles", "replica_audit", "cluster_mixtures"), ("structure_summary",), (), "changepoint")
def summarize_structures(s):
    """One row per structure: rank, name, share, lifetimes, doubts."""
    v = s.values
    return {"structure_summary": metastable.summarize_structures(v["structure_ranking"], v["cluster_profiles"], v["replica_audit"], v["cluster_mixtures"])}


@op("run_metastable_pipeline", ("features", "segments", "segment_cuts"), ("k_selected", "structure_summary"), (P("grp", required=True), P("columns", "array", required=True), P("structure", required=True), P("edges", "array", required=True), P("poles", "array", required=True), P("draws", "integer", default=500)), "changepoint")
def metastable_run(s, grp, columns, structure, edges, poles, draws):
    """From segments and their cuts to ranked, named structures."""
    seg = s.values["segments"].where(F.col("grp") == grp)
    cuts = s.values["segment_cuts"].where(F.col("grp") == grp).drop("grp")
    return metastable.run(s.values["features"], seg, cuts, [c for c in seg.columns if c.endswith("_mean")], list(columns), structure, list(edges), list(poles), draws)


@op("run_gsa_step1_cluster_k", ("segments",), ("cohort_cuts", "silhouette_peaks", "k_splits", "segment_dynamics"), (COHORT, P("k_from", "integer", default=5), P("k_to", "integer", default=6)), "changepoint")
def cohort_clusters(s, by, k_from, k_to):
    """Cuts of every cohort's segments at every k, cohorts beside each other, and what speaks for one k."""
    by, seg = list(by or ["grp"]), s.values["segments"]
    matrix = clustering.feature_matrix(seg, [c for c in seg.columns if c.endswith(("_mean", "_std"))], by)
    cuts = clustering.cuts(matrix, ["traj_id", "segment_id"], by)
    return {"cohort_cuts": cuts} | metastable.compare_cluster_k(cuts, seg, k_from, k_to, by)


@op("compare_endpoint_cluster_k", ("segment_cuts", "segments"), ("silhouette_peaks", "k_splits", "segment_dynamics"), (COHORT, P("k_from", "integer", default=5), P("k_to", "integer", default=6)), "changepoint")
def compare_k(s, by, k_from, k_to):
    """What speaks for one k or the next."""
    return metastable.compare_cluster_k(s.values["segment_cuts"], s.values["segments"], k_from, k_to, list(by or ["grp"]))


@op("compare_endpoint_clusters_across_cohorts", ("clusters",), ("cohort_clusters",), (COHORT, P("proxies", "array")), "changepoint")
def compare_cohorts(s, by, proxies):
    """Clusters of all cohorts side by side."""
    c = s.values["clusters"]
    return {"cohort_clusters": metastable.compare_across_cohorts(c, list(proxies) if proxies else [x for x in c.columns if x.endswith("_mean")], list(by or ["grp"]))}


@op("check_cage_symmetry", ("molecules",), ("cage_symmetry",), (P("permutations", "array", required=True), P("most", "number", "largest mean distance", 1.0)), "changepoint")
def check_symmetry(s, permutations, most):
    """Relabellings of molecules that a cage admits."""
    return {"cage_symmetry": metastable.cage_symmetry(s.values["molecules"], permutations, float(most))}


# ---- states, selection, scores


@op("cluster_frames", ("pca_scores",), ("frame_clusters", "frame_medoids"), (P("k_min", "integer", default=2), P("k_max", "integer", default=10)), "clustering")
def cluster_frames(s, k_min, k_max):
    """Frames by k-means at the best silhouette, with medoids."""
    out = clustering.kmeans_by_silhouette(s.values["pca_scores"], "pcs", k_min, k_max)
    return {"frame_clusters": out, "frame_medoids": clustering.medoids(out, "frame", "pcs", "cluster")}


@op("markov_states", ("pca_scores",), ("state_labels", "state_transitions"), (P("n_micro", "integer", default=1500), P("n_macro", "integer", default=22), P("lag", "integer", default=1)), "clustering")
def markov_states(s, n_micro, n_macro, lag):
    """Micro- and macrostates of projected frames, and their transitions."""
    model = states.StateModel(s.values["pca_scores"], "pcs", components=len(s.values["pca_scores"].first()["pcs"]), n_micro=n_micro, n_macro=n_macro, lag=lag)
    found = model.run()
    return {"state_labels": found["labels"], "state_transitions": found["transitions"], "state_quality": found["quality"]}


@op("select_frames", ("pca_scores", "rmsd", "rg"), ("selected_frames",), (P("most", "integer", default=30), P("apart", "number", default=0.75)), "selection")
def select_frames(s, most, apart):
    """Frames worth looking at."""
    df: DataFrame = s.values["pca_scores"].join(s.values["rmsd"], ["traj_id", "frame"]).join(s.values["rg"], ["traj_id", "frame"])
    return {"selected_frames": scoring.select_frames(scoring.score_frames(df), most=most, apart=float(apart))}


@op("score_simulation", ("run_summaries",), ("simulation_score",), (P("require_entry", "boolean", default=False), P("least_pct", "number", default=10.0)), "scoring")
def score_simulation(s, require_entry, least_pct):
    """Runs with their scores, part by part."""
    return {"simulation_score": scoring.score_runs(s.values["run_summaries"], require_entry, float(least_pct))}


@op("rescore_simulations", ("run_summaries",), ("simulation_score",), (P("require_entry", "boolean", default=False), P("least_pct", "number", default=10.0)), "scoring")
def rescore(s, require_entry, least_pct):
    """Runs scored anew from stored numbers and whatever side tables there are."""
    sides = {name: s.values[f"run_{name}"] for name in ("volumes", "correlations", "distances", "guests") if f"run_{name}" in s.values}
    return {"simulation_score": rescoring.rescore(s.values["run_summaries"], require_entry, float(least_pct), **sides)}


@op("list_annotation_replicas", ("handoffs",), ("annotation_replicas",), (), "changepoint")
def annotation_replicas(s):
    """Series that show one clean leaving of a tight state."""
    return {"annotation_replicas": attribution.annotation_series(s.values["handoffs"])}
