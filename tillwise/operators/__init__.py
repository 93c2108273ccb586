"""DataFrame -> DataFrame operators and the column expressions behind them."""
