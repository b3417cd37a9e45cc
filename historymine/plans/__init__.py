from historymine.plans.mining import FullTreeRun, MiningRun, mine_full_tree, mine_history, mine_in_stages, summarize_commits
from historymine.plans.store import RunStore

__all__ = ["FullTreeRun", "MiningRun", "RunStore", "mine_full_tree", "mine_history", "mine_in_stages", "summarize_commits"]
