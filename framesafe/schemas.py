"""Schemas of the stored documents, declared in one place.

Names that start with the analysis service's prefix are built from a parameter (``service``), so stored
documents of any deployment can be read.
"""

from __future__ import annotations

from pyspark.sql import types as T

RANGE = "struct<start_sec:double,end_sec:double>"
VIDEO_METADATA = "struct<fps:double,width:int,height:int,total_frames:bigint,duration_sec:double>"
PERSON = (
    f"struct<name:string,description:string,time_ranges:array<{RANGE}>,should_anonymize:boolean,is_official:boolean,"
    "review_required:boolean,redaction_reason:string,tags:array<string>,confidence:double>"
)
SCENES = "struct<scenes:array<struct<start_sec:double,end_sec:double,description:string>>>"
APPEARANCE = "struct<frame_idx:bigint,timestamp:double,bbox:array<double>>"


def manifest(service: str = "service") -> T.StructType:
    return T.StructType.fromDDL(
        f"job_id string, status string, created_at string, video_path string, video_filename string, {service}_video_id string, "
        f"video_metadata {VIDEO_METADATA}, {service}_status string, local_status string, {service}_people array<{PERSON}>, "
        f"{service}_objects array<string>, {service}_scene_summary {SCENES}"
    )


def detections() -> T.StructType:
    return T.StructType.fromDDL(
        "version int, "
        "unique_faces array<struct<person_id:string,stable_person_id:string,cluster_person_id:string,bbox:array<double>,"
        f"encoding:array<float>,appearances:array<{APPEARANCE}>,appearance_count:int,name:string,description:string,"
        f"time_ranges:array<{RANGE}>,tags:array<string>,should_anonymize:boolean,is_official:boolean,review_required:boolean,"
        "description_match_score:double,description_confidence:double,redaction_reason:string,priority_rank:int,entity_id:string,"
        "entity_asset_ids:array<string>,snap_filename:string,snap_path:string>>, "
        "unique_objects array<struct<object_id:string,identification:string,bbox:array<double>,"
        "appearances:array<struct<frame_idx:bigint,timestamp:double,bbox:array<double>,confidence:double>>,appearance_count:int,"
        "snap_filename:string,snap_path:string>>"
    )

TARGET = (
    "struct<object_class:string,entity_id:string,redaction_target:string,scene_role:string,redaction_decision:string,"
    "subject_selection:string,inclusion_reason:string,start_sec:double,end_sec:double>"
)


def privacy_artifact(service: str = "service") -> T.StructType:
    return T.StructType.fromDDL(
        "metadata struct<artifact_id:string,job_id:string,video_id:string,local_job_id:string,source_fingerprint:string,"
        "cache_key:string,model:string,prompt_version:string,schema_version:string,duration_sec:double,created_at:string,"
        f"status:string,{service}_task_id:string,source_type:string,usage:map<string,string>,updated_at:string>, "
        "summary struct<overall_summary:string,privacy_risk_level:string,review_priority:string>, "
        "timeline_events array<struct<id:string,start_sec:double,end_sec:double,severity:string,category:string,label:string,"
        "description:string,reason:string,redaction_target:string,scene_role:string,redaction_decision:string,"
        "subject_selection:string,inclusion_reason:string,handling_note:string,confidence:double,review_required:boolean,"
        "recommended_action_ids:array<string>>>, "
        "recommended_actions array<struct<id:string,type:string,label:string,reason:string,confidence:double,"
        f"event_ids:array<string>,target:{TARGET},apply_mode:string>>"
    )


def lane() -> T.StructType:
    return T.StructType.fromDDL(
        "build_version int, job_id string, person_id string, "
        "video struct<width:int,height:int,fps:double,total_frames:bigint,duration_sec:double>, "
        "segments array<struct<start_frame:bigint,end_frame:bigint>>, built_at string, "
        "lane array<struct<f:bigint,t:double,x1:double,y1:double,x2:double,y2:double,src:string,conf:double>>"
    )
