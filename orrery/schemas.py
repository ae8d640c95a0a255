"""Schemas of the engine's tables, as DDL, and how older tables are read under them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = {
    "sources": "id string, name string, kind string, adapter string, mode string, stale_after_hours double, delayed_after_hours double, requires_key boolean, key_env string, health string, last_success string, record_count bigint",
    "source_runs": "id bigint, source_id string, started_at string, finished_at string, status string, records_in bigint, records_kept bigint, records_outside bigint, records_invalid bigint, reasons map<string,bigint>, error string",
    "events": "id string, source_id string, type string, category string, title string, start_time string, end_time string, status string, evidence_type string, lon double, lat double, scope string, attributes string, created_at string, updated_at string",
    "entities": "id string, source_id string, type string, category string, name string, lon double, lat double, attributes string, updated_at string",
    "provenance": "id string, kind string, source string, ref string, sha256 string, processing string, version string, parameters string, created_at string",
    "audit_log": "id bigint, at string, actor string, action string, target string, details string, prev_hash string, hash string",
    "scenes": "id string, aoi_id string, acquired_at string, satellite string, grid string, baseline string, offset double, valid_fraction double, quality_status string, file string, sha256 string",
    "tiles": "tile_id string, aoi_id string, row int, col int, lon double, lat double",
    "tile_observations": "scene_id string, tile_id string, land_class string, valid_fraction double, water double, vegetation double, open double, features map<string,double>",
    "change_candidates": "id string, aoi_id string, class string, direction string, from_class string, to_class string, tile_ids array<string>, earliest_after string, latest_before string, lon double, lat double, area_m2 double, score double, gates array<struct<gate:string,passed:boolean,detail:string>>, accepted boolean, review_state string",
    "decisions": "id bigint, target_id string, decision string, label string, analyst string, note string, created_at string",
    "chips": "id string, model_key string, preprocess_version string, scene_id string, aoi_id string, acquired_at string, chip_px int, row_off int, col_off int, lon double, lat double, valid_fraction double, embedding array<float>",
    "cluster_versions": "version string, status string, input_fingerprint string, created_at string",
    "clusters": "version string, family int, cluster int, centroid array<double>, radius double, size bigint, silhouette double",
    "cluster_members": "version string, family int, cluster int, id string, sim double",
    "ml_runs": "id string, before_scene string, after_scene string, model_key string, preprocess_version string, created_at string",
    "ml_regions": "id string, run_id string, region int, pixels int, mean_score double, flags array<string>, review_state string",
    "ai_outputs": "id bigint, capability string, model string, kind string, confidence double, evidence array<string>, created_at string",
    "jobs": "id bigint, kind string, parameters string, status string, result string, created_at string, finished_at string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def migrated(df: DataFrame, name: str) -> DataFrame:
    """df under today's schema: missing columns are null, others of the same name are cast, extra ones go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name).fields])
