"""Expense-claim audits over whole tables, written as Spark DataFrame jobs."""
