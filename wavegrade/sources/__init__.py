"""Tables of orders, answers, runs, samples and logs."""
