"""Registered queries of the library and the SQL that checks them."""

from lumenloom.plans import queries as q
from lumenloom.plans.more_oracles import MORE
from lumenloom.plans.page_oracles import PAGES
from lumenloom.plans.oracles import ORACLES
from lumenloom.plans.step_oracles import STEPS

FLAGSHIP = "contrast_matrix"
NAMES = [
    "contrast_matrix",
    "contrast_summary",
    "contrast_pivot",
    "color_lab",
    "color_nearest",
    "stacked_copies",
    "colour_uses",
    "palette_merge",
    "palette_roles",
    "palette_chain",
    "guide_chain",
    "logo_places",
    "typography_by_role",
    "first_screen_shares",
    "points_shared",
    "logo_colours",
    "site_domain_rollup",
    "page_key_dedupe",
    "page_titles",
    "page_links",
    "page_text",
    "page_nodes",
    "link_places",
    "page_logos",
    "shapes_borrowed",
    "svg_cascade",
    "svg_clean",
    "page_locale_filter",
    "choose_pages_topk",
    "official_site_rank",
    "line_dedupe",
    "excerpt_budget",
    "excerpt_pick",
    "word_count",
    "normalise_text",
    "quote_check",
    "quote_summary",
    "mentions_semi",
    "unquoted_anti",
    "numbered_names",
    "prompt_build",
    "job_state_latest",
    "job_steps_pivot",
    "reuse_asof_24h",
    "daily_limit",
    "sliding_limiter",
    "limiter_returns",
    "joined_runs",
    "cancelled_jobs",
    "usage_cost",
    "fallback_answer",
    "retention_filter",
    "lru_finished",
    "set_ops_links",
    "scale_labels",
    "merged_reads",
    "export_css",
    "export_tailwind",
    "export_voice",
    "export_tokens",
    "export_json",
    "events_state_stream",
    "read_outcomes",
    "retry_set",
    "skip_warnings",
    "kinds_linked",
    "gaps_filled",
    "page_icons",
    "site_names",
    "durations",
    "font_stacks",
    "safe_addresses",
    "empty_sections",
    "model_rounds",
    "paper_colours",
    "contrast_grid",
    "token_contrast",
    "measurements_checked",
    "drawing_holes",
    "sites_in_turn",
    "pages_in_turn",
    "portable_logos",
]
ORACLES = {**ORACLES, **MORE, **PAGES, **STEPS}
QUERIES = {name: getattr(q, name) for name in NAMES}

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
