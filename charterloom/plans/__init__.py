"""Plan-level helpers: materialised stages and whole-pipeline plans."""
