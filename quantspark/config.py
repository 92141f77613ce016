"""Parameters of a run. Frozen: a plan takes its literals from one Config."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields

# The patterns, tables and limits of the drawings' own conventions.
CODE_REGEX = r"^([0-9]x)?[A-ZÅÄÖ]{1,4}[0-9=+\-][A-ZÅÄÖ0-9+=\.\(\)\-]*$"
DIM_REGEX = r"^[0-9VF+ØÖ]"
DIM_PART_REGEX = r"^[0-9]+([\.,][0-9]+)?(\(.*\))?$"
WATER, SEWER, HEAT, COOLING, AIR, UNKNOWN = "Rör tappvatten", "Spill- dagvatten", "Rör värme", "Rör kyla", "Luftbehandling", "Okänt system"
SYSTEM_PREFIXES = {"KV": WATER, "VV": WATER, "VVC": WATER, "S": SEWER, "D": SEWER}
VERTICAL_HEIGHTS = {WATER: 2.8, SEWER: 2.8, UNKNOWN: 2.8}

Zone = tuple[float, float, float, float]


@dataclass(frozen=True)
class Config:
    """Defaults are in points (1/72 inch) unless the name says otherwise."""

    # Names and defaults are those of the configuration files that users have.

    dpi: int = 450
    tile_px: int = 1200
    tile_overlap: float = 0.25
    psm_modes: tuple[int, ...] = (11, 6)
    ocr_lang: str = "swe"
    min_conf: float = 30.0
    code_regex: str = CODE_REGEX
    dim_regex: str = DIM_REGEX
    dim_part_regex: str = DIM_PART_REGEX
    dedup_tol_pt: float = 12.0
    pair_gap_min_pt: float = -2.0
    pair_gap_max_pt: float = 20.0
    pair_min_h_overlap: float = 0.3
    force_ocr: bool = False
    skip_ocr: bool = False
    native_word_threshold: int = 100
    ocr_declutter: bool = True
    ocr_threads: int = 0
    min_tile_ink: float = 0.002
    use_layers: bool = True
    pipe_layer_regex: str | None = None
    pipe_layers: tuple[str, ...] | None = None
    pipe_width: float | None = None
    pipe_widths: tuple[float, ...] | None = None
    pipe_width_ratio: float = 0.45
    min_coverage: float = 0.5
    pipe_width_tol: float = 0.15
    min_cluster_count: int = 40
    min_cluster_frac: float = 0.002
    pipe_color: tuple[float, float, float] | None = None
    color_tol: float = 0.15
    chain_tol_pt: float = 1.5
    dash_gap_pt: float | None = None
    dash_angle_deg: float = 8.0
    crossing_gap_pt: float = 0.0
    bezier_steps: int = 4
    frame_len_pt: float = 700.0
    split_at_junctions: bool = True
    junction_straight_deg: float = 30.0
    min_chain_len_pt: float = 3.0
    min_run_m: float | None = None
    label_min_m: float = 1.0
    leader_max_width_ratio: float = 0.8
    leader_min_len_pt: float = 4.0
    leader_max_len_pt: float = 250.0
    leader_code_tol_pt: float = 15.0
    leader_pipe_tol_pt: float = 8.0
    proximity_link_pt: float = 25.0
    diagonal_min_deg: float = 4.0
    scale: str | None = None
    vertical_heights: dict[str, float] = field(default_factory=lambda: dict(VERTICAL_HEIGHTS))
    system_prefixes: dict[str, str] = field(default_factory=lambda: dict(SYSTEM_PREFIXES))
    nx_multiplies_length: bool = False
    symbol_max_diameter_pt: float = 10.0
    symbol_pipe_tol_pt: float = 6.0
    exclude_zones: tuple[Zone, ...] = ()
    layers: tuple[str, ...] = ("codes", "pipes")
    page: int = 0
    #: Off: zones keep their effect on segments only where pipes are chosen by pen width, as in the manual workflow.
    zones_cut_layer_pipes: bool = False
    #: Off: line work is merged before it is divided by layer, so collinear pieces of two layers can fuse.
    merge_within_layer: bool = False
    #: Off: a row that looks like a dimension is taken as one even if it is a code itself.
    codes_are_no_dimensions: bool = False

    @classmethod
    def from_json(cls, text: str) -> Config:
        """Unknown keys raise KeyError; lists become tuples."""
        known = {f.name for f in fields(cls)}
        values = json.loads(text)
        for key in values:
            if key not in known:
                raise KeyError(f"Okänd konfignyckel: {key}")

        def frozen(v):
            return tuple(frozen(x) for x in v) if isinstance(v, list) else v

        return cls(**{k: frozen(v) for k, v in values.items()})

    @classmethod
    def from_file(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @property
    def min_branch_pt(self) -> float:
        return max(self.min_chain_len_pt, 2 * self.chain_tol_pt)


def anchored(pattern: str) -> str:
    """A pattern that matches from the start: rlike searches anywhere."""
    return f"^(?:{pattern})"


def parse_vertical_heights(spec: str) -> dict[str, float]:
    """'System=2.8,Other=3,1'-like lists: a part without '=' is the decimals of the value before it."""
    parts = [p.strip() for p in spec.split(",")]
    out: dict[str, str] = {}
    name = ""
    for part in filter(None, parts):
        if "=" in part:
            name, value = (x.strip() for x in part.rsplit("=", 1))
            out[name] = value
        elif name and part.isdigit() and "." not in out[name]:
            out[name] += "." + part
        else:
            raise ValueError(f"Ogiltig vertikalhöjd: {part!r}")
    return {k: float(v) for k, v in out.items()}


def parse_zone(spec: str) -> Zone:
    """'x0,y0,x1,y1', corners in any order."""
    v = [float(x) for x in spec.split(",")]
    if len(v) != 4:
        raise ValueError(f"Ogiltig zon: {spec!r}")
    return min(v[0], v[2]), min(v[1], v[3]), max(v[0], v[2]), max(v[1], v[3])


def zones_from_fractions(spec: str, width: float, height: float) -> tuple[Zone, ...]:
    """Zones given as fractions of the page, ';' between them."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        x0, y0, x1, y1 = parse_zone(part)
        out.append((x0 * width, y0 * height, x1 * width, y1 * height))
    return tuple(out)


MM_IN_POINT = 25.4 / 72.0


def points_per_meter(ratio: float) -> float:
    """Points on paper of a metre at scale 1:ratio."""
    return 1000.0 / ratio / MM_IN_POINT


def parse_scale(spec: str) -> float:
    """'1:50' or '56.69pt/m' (comma allowed) in points per metre."""
    text = spec.strip()
    if m := re.fullmatch(r"1\s*:\s*(\d{1,4})", text):
        return points_per_meter(int(m[1]))
    if m := re.fullmatch(r"([0-9]+(?:[.,][0-9]+)?)\s*pt/m", text, re.IGNORECASE):
        return float(m[1].replace(",", "."))
    raise ValueError(f"Ogiltig skala '{text}' – använd '1:50' eller '56.69pt/m'")


def safe_name(name: str, most: int = 80) -> str:
    """A file name of letters, digits and '._- '."""
    return "".join(c for c in name if c.isalnum() or c in "._- ")[:most]
