"""The registered queries, each beside the SQL that must give the same rows."""


def registry():
    from checks import ampute, common, encode, experiments, impute, learn, metafeatures, sources  # noqa: F401

    return common.QUERIES, common.SQL
