from plantables.plans import conversion, core, loads, paged, repairs, scalars, spanned  # noqa: F401  they register their queries
