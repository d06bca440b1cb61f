"""Set-wise access governance on Spark: grants, delegations, guarded reads, audit trails."""
