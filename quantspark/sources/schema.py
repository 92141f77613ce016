"""The input contract: tables keyed by (doc_id, page_no)."""

PAGES = "doc_id string, page_no int, width double, height double"
HITS = "doc_id string, page_no int, hit_seq long, text string, x0 double, y0 double, x1 double, y1 double, conf double, source string, psm int"
ITEMS = "doc_id string, page_no int, path_id long, item_seq int, kind string, coords array<double>, width double, r double, g double, b double, layer string"
ZONES = "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double"
