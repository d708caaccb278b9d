"""Column -> Column functions, all JVM-side unless the name says otherwise."""

from chromafield.functions.codec import (
    block_hash,
    cov_expand,
    cov_pack,
    embedding_prefix,
    hash_prefix,
    mask_bits,
    mask_count,
    mask_has,
    mask_members,
    pack_source,
    unpack_source,
)
from chromafield.functions.color import (
    freq_to_hue,
    freq_to_material_id,
    hsl,
    level_bucket,
    octave_fold,
    particle_color,
)
from chromafield.functions.physics import (
    bearing,
    fresnel_r,
    iq_features,
    lf_hf_split,
    link_budget,
    normalize_freq,
    path_phase,
    propagation_speed,
    qpc_to_us,
    radial_velocity,
    rf_roughness,
    wet_permittivity,
)
from chromafield.functions.registry import register_sql_functions
from chromafield.functions.text import (
    corpus_day,
    event_line,
    is_diagnostic,
    motif_edit_distance,
    motif_name,
    parse_capture_name,
    parse_note,
    parse_particle,
    validate_settings,
)
from chromafield.functions.vectors import cosine, dot, l2, norm

__all__ = [name for name in dir() if not name.startswith("_")]
