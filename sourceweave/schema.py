"""Column types of the graph's tables."""

NODE = "id string, label string, file_type string, source_file string, source_location string, computed_name string"
EDGE = "source string, target string, relation string, confidence string, source_file string, source_location string, weight double, confidence_score double"
GRAPH_NODE = NODE + ", community int, norm_label string"
#: One row for each thing that an extractor finds; the columns that a kind does not use are null.
FRAGMENT = (
    "file string, file_idx int, kind string, pos int, id string, label string, file_type string, loc string, computed_name string, source_file string, "
    "source string, target string, relation string, confidence string, weight double, confidence_score double, name string, is_member boolean, extra string"
)
EXTRACTED, INFERRED, AMBIGUOUS = "EXTRACTED", "INFERRED", "AMBIGUOUS"
SCORES = {EXTRACTED: 1.0, INFERRED: 0.5, AMBIGUOUS: 0.2}
