"""Plan-level building blocks: staging, checked broadcasts, blocked scans and folds."""
