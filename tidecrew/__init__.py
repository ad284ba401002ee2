"""Clean-up drive, donation and recycled-goods marketplace analytics on Spark."""
