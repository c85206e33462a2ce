"""Fixed schemas of the text sources; empty inputs have them too."""

LABELS = (
    "seq string, frame string, line_idx int, version string, available string, cls string, track_id bigint, prev_track_id bigint, "
    "x double, y double, z double, yaw double, l double, w double, h double, bad boolean"
)
HEADERS = "seq string, frame string, rdr string, ldr64 string, camf string, ldr128 string, camr string, tstamp string"
KITTI = (
    "line_idx int, cls string, truncated double, occluded double, alpha double, x0 double, y0 double, x1 double, y1 double, "
    "h double, w double, l double, loc_x double, loc_y double, loc_z double, rot_y double, score double"
)
