"""quirefold: page-description text recovery, analysis and rewriting as Spark jobs."""
