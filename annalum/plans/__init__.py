"""Named queries: operators bound to tables, each beside SQL that gives the same rows."""
