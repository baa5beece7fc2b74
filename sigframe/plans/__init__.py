"""Layout techniques shared by the operators: blocks with halos, two-pass scans, dense numbering."""
