"""promptscore: validate, score, retry and summarise very large tables of prompts on Spark."""

from promptscore.options import Options
from promptscore.session import configure, new_work_dir

__all__ = ["Options", "configure", "new_work_dir"]
