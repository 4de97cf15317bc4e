"""Every threshold of the linkage, in one place, and the configured exceptions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # Distances are degrees unless the name says otherwise.
    endpoint_km: float = 5.0
    nearest_kept: int = 10
    pairs_tried: int = 5
    ratio_low: float = 0.4
    ratio_high: float = 2.5
    corridor_buffer: float = 0.01
    overlap_buffer: float = 0.005
    direction_least: float = 0.7
    visual_least: float = 0.65
    simple_vertices: int = 5
    late_buffer_m: float = 2000.0
    late_least: float = 0.4
    parallel_least: float = 0.5
    signature_near: float = 0.01
    signature_late: float = 0.02
    signature_length: float = 0.1
    similar_iou: float = 0.6
    path_iou: float = 0.5
    twin_hausdorff: float = 0.0005
    twin_ratio: float = 0.05
    bus_least: float = 0.6
    bus_tolerance_m: float = 5000.0
    group_least: float = 0.6
    extend_ratio: float = 0.8
    extend_most: int = 10
    extend_reach: float = 1.25
    extend_iou: float = 0.2
    transformer_km: float = 5.0
    transformer_kv: float = 10.0
    allowed_kv: tuple[float, ...] = (220, 225, 380, 400)
    allowed_kv_slack: float = 5.0
    split_kv: float = 220.0
    national_circuit_km: float = 36_002.0


# Corridors whose lines share circuits, by name: capacity and, per reference id, its segments.
CORRIDORS = {
    "Gundelfingen-Voehringen": (
        1,
        {
            "244": ["relation/1641463-380-a", "relation/1641463-380-b", "relation/1641463-380-c", "relation/1641463-380-e"],
            "245": ["relation/1641474-380-a", "relation/1641474-380-b", "relation/1641474-380-c", "relation/1641474-380-e"],
        },
    )
}

# Links set by hand, reference id to model ids.
MANUAL_LINKS = {
    "2611": ["merged_relation/3916226-380-c+3", "merged_way/240543053-1-380-a+5"],
    "2695": ["merged_way/30970013-1-380+3"],
    "2908": ["relation/3717719-220"],
    "2566": ["relation/3918229-220-b"],
    "2916": ["merged_way/27854188-2-220+1"],
    "2719": ["merged_way/30970013-2-220+3"],
    "390": ["merged_way/26565859-380+1"],
    "392": ["merged_way/26565859-380+1"],
    "2488": ["way/45737386-380"],
    "2465": ["merged_way/26971631-220+1"],
    "2629": ["merged_way/156350633-220+3"],
    "2498": ["merged_way/296751942-220+1"],
    "2509": ["merged_way/178708511-220+1"],
    "2875": ["merged_way/114397559-380+3"],
    "2557": ["merged_way/842418530-1-380+1", "way/41232147-380"],
    "2612": ["merged_relation/3989163-380-e+2"],
    "2618": ["merged_relation/14514288-380-b+5"],
    "245": ["merged_way/1104699060-380+2", "way/108526453-380", "way/108526459-1-380", "way/95860782-380"],
}
