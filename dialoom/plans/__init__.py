"""Generation plans, prompts, response processing, cost."""
