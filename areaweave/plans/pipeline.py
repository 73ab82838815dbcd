"""The whole job: requests in, files, manifest and run records out, all areas at once."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaweave.operators import audit
from areaweave.operators.boundary import normalise_requests, resolve_boundaries
from areaweave.operators.clean import clean_layers
from areaweave.operators.layers import check_strict, extract_features, layer_counts, layer_notes
from areaweave.operators.reuse import content_fingerprints, pending_areas
from areaweave.operators.scale import through_table
from areaweave.sinks import files, snapshots
from areaweave.sources.geojson import read_manual
from areaweave.sources.ledger import check_inputs, input_notes


@dataclass(frozen=True)
class Run:
    """Everything a run produces, keyed by lga_id."""

    boundaries: DataFrame
    rejected: DataFrame
    layers: DataFrame
    quarantined: DataFrame
    warnings: DataFrame
    manifest: DataFrame
    runs: DataFrame
    outcomes: DataFrame


def export_layers(
    layers: DataFrame, boundaries: DataFrame, path: str, rules: dict | None = None, write: bool = True
) -> DataFrame:
    """Write all layers both ways and return the manifest."""
    manifest = audit.export_manifest(audit.category_counts(layers), boundaries, path, rules)
    if write:
        files.write_geojson(layers, path)
        files.write_by_category(layers, path)
        files.write_manifest(manifest, path)
    return manifest


def extract_lgas(
    requests: DataFrame,
    gazetteer: DataFrame,
    elements: DataFrame,
    path: str = "output",
    rules: dict | None = None,
    manual: DataFrame | None = None,
    strict: bool = False,
    write: bool = True,
    timestamp: datetime | None = None,
    finished: DataFrame | None = None,
    ledger: DataFrame | None = None,
    snapshot: str | None = None,
    by_content: bool = False,
) -> Run:
    """Resolve, extract, clean, export and log every requested area.

    Three results are read more than once and therefore written to intermediate
    tables: the boundaries, the raw features and the cleaned layers.  ``strict``
    raises on a bad rule or an unresolved area before anything is exported.
    Areas with a record in ``finished`` (see read_runs) under the same rules are
    left out; with ``by_content`` only those in which nothing changed since (see content_fingerprints), which
    every record keeps as ``content_hash``: they are matched with the elements, and go no further.  Boundary files that ``requests`` names are read unless ``manual`` has them.
    Rejected requests and features left out are written, counted in ``outcomes``, and
    noted in the warnings of their area.  A ``ledger`` of the elements' files (see read_ledger) turns
    broken ones into notes for their layers, or raises if ``strict``.  With a ``snapshot``, a new run id,
    everything is written below it and counts once the last step has committed it (see read_snapshot).
    """
    if strict:
        check_strict(rules)
    broken = None if ledger is None else through_table(input_notes(ledger, rules))
    if strict and broken is not None:
        check_inputs(broken)
    if finished is not None and not by_content:
        requests = audit.pending_requests(requests, finished, rules)
    if manual is None and "manual_path" in requests.columns:
        named = normalise_requests(requests).where("manual_path IS NOT NULL").select("manual_path").distinct()
        manual = read_manual(requests.sparkSession, [row["manual_path"] for row in named.toLocalIterator()])
    resolution = resolve_boundaries(requests, gazetteer, manual, strict=strict)
    boundaries = through_table(resolution.accepted)
    raw = through_table(extract_features(elements, boundaries, rules))
    # At most a row for each layer.
    troubles = [] if broken is None else broken.collect()
    prints = content_fingerprints(raw, boundaries, [row["message"] for row in troubles])
    if finished is not None and by_content:
        prints = through_table(prints)
        pending = through_table(pending_areas(prints, finished, rules))
        boundaries = through_table(boundaries.join(pending, "lga_id", "left_semi"))
        raw = raw.join(pending, "lga_id", "left_semi")
    notes = layer_notes(layer_counts(raw, boundaries, rules), rules)
    if broken is not None:
        found = [F.struct(*[F.lit(row[c]).alias(c) for c in broken.columns]) for row in troubles]
        if found:
            notes = notes.unionByName(boundaries.select("lga_id", F.inline(F.array(*found))).select(*notes.columns))
    cleaned = clean_layers(raw)
    outcomes = through_table(cleaned.audit)
    warnings = audit.fold_warnings(boundaries, notes.unionByName(audit.left_out_notes(outcomes, rules)))
    layers = through_table(cleaned.layers)
    manifest = export_layers(layers, boundaries, path, rules, write and snapshot is None)
    runs = audit.run_records(boundaries, manifest, warnings, rules, timestamp).join(prints, "lga_id", "left")
    if write and snapshot is not None:
        tables = {"layers": layers, "quarantined": cleaned.quarantined, "rejected": resolution.rejected, "manifest": manifest, "runs": runs}
        snapshots.stage(tables, path, snapshot)
        areas = boundaries.select("lga_id").unionByName(resolution.rejected.select("lga_id"))
        snapshots.commit(areas.where("lga_id IS NOT NULL"), path, snapshot, timestamp)
    elif write:
        files.write_left_out(resolution.rejected, cleaned.quarantined, path)
        files.write_runs(runs, path)
    return Run(boundaries, resolution.rejected, layers, cleaned.quarantined, warnings, manifest, runs, outcomes)
