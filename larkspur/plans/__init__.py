"""The study's tables and every registered query."""

import larkspur.registry  # noqa: F401  it loads all plans in an order that suits them, whichever is asked for first
