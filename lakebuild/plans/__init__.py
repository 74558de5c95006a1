from .pipelines import (build_dim_company, build_dim_security, build_fact_market_history,
                        build_financial, market_batches, run_all, stage_finwire, stage_industry)

__all__ = ["build_dim_company", "build_dim_security", "build_fact_market_history",
           "build_financial", "market_batches", "run_all", "stage_finwire", "stage_industry"]
