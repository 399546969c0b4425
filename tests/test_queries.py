"""Each book's queries against their SQL on the smallest tables (a few of each family; the rest run in the correctness gate)."""

import numpy as np
import pytest
from compare import same

from stratagrid.operators import pmax
from stratagrid.plans import catalog
from stratagrid.sources import views as V

NAMES = [
    "depth_from_focus", "a1_winner", "a1_winner_two_step", "a4_tent_render", "a7_render_gains", "a13_percentiles", "a16_concentration", "a18_weighted_median", "p5_tone", "p8_black_point",
    "j3_band_join", "j7_nearest_survivor", "w1_gap_split", "w2_frame_order", "w7_summed_area", "n1_gaussian", "n1_gaussian_tiles", "n2_laplacian_tiles", "n6_lanczos_warp", "n11_components",
    "n12_bounded_reach", "n16_collapse", "d3_confidence_gated", "d5c_neighbour_curves", "d5g_guided", "d6_blend", "m4_tracks", "m9_merge", "m12_govern", "r6_blame", "u3_replay", "f6_coverage_crop",
    "f2_fuse_without_excluded", "m1_pyramid_tiles", "m2_select", "m8_open_field", "m10_texture_veto", "f9_sharp_mask", "r1_ratio_test", "r1_consensus", "a25_searched_offset", "u3_undoable", "k5_aligned_frames", "u6_noise_preview", "m12_lit_regions", "m12_lit_cells",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    same(catalog.queries()[name](spark, sf).toPandas(), duck.execute(catalog.oracle_sql()[name]).df())


def test_flagship(spark, sf):
    assert catalog.flagship(spark, sf).count() == 640


def test_pyramid_fuse_takes_all_frames(spark, sf):
    px = V.rgb_stack(spark, sf, holes=False)
    assert px.where("frame >= 6").count() > 0
    ref = pmax.fuse(px, 8, 8, pmax.Options(coarse_levels=0, normalize_exposure=False), n_levels=2).toPandas().sort_values(["stack", "y", "x"])
    got = catalog.queries()["m1_pyramid_fuse"](spark, sf).toPandas().sort_values(["stack", "y", "x"])
    assert len(got) == len(ref) and all(np.allclose(got[c], ref[c], atol=1e-4) for c in "rgb")


def test_names_agree():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
