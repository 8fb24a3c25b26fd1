"""Target names of published columns, where they don't follow from the words of the column."""

from __future__ import annotations

#: Published column = target column, by file.
SUPPLIER_FILES = """
Suplr_Prvdr_Last_Name_Org = supplier_last_org_name
Suplr_Prvdr_First_Name = supplier_first_name
Suplr_Prvdr_MI = supplier_middle_initial
Suplr_Prvdr_Crdntls = supplier_credentials
Suplr_Prvdr_Ent_Cd = entity_code
Suplr_Prvdr_St1 = supplier_address_line1
Suplr_Prvdr_St2 = supplier_address_line2
Suplr_Prvdr_City = supplier_city
Suplr_Prvdr_State_Abrvtn = supplier_state
Suplr_Prvdr_State_FIPS = supplier_state_fips
Suplr_Prvdr_Zip5 = supplier_zip5
Suplr_Prvdr_RUCA_Cat = supplier_ruca_category
Suplr_Prvdr_RUCA = supplier_ruca
Suplr_Prvdr_RUCA_Desc = supplier_ruca_description
Suplr_Prvdr_Cntry = supplier_country
Suplr_Prvdr_Spclty_Cd = supplier_specialty_code
Suplr_Prvdr_Spclty_Desc = supplier_specialty_description
Suplr_Prvdr_Spclty_Srce = supplier_specialty_source
DME_Sprsn_Ind = dme_suppression_indicator
DME_Tot_Suplr_HCPCS_Cds = dme_total_hcpcs_codes
DME_Tot_Suplr_Benes = dme_total_beneficiaries
DME_Tot_Suplr_Clms = dme_total_claims
DME_Tot_Suplr_Srvcs = dme_total_services
DME_Suplr_Sbmtd_Chrgs = dme_submitted_charge
DME_Suplr_Mdcr_Alowd_Amt = dme_medicare_allowed_amount
DME_Suplr_Mdcr_Pymt_Amt = dme_medicare_payment_amount
DME_Suplr_Mdcr_Stdzd_Pymt_Amt = dme_medicare_standardized_payment_amount
POS_Sprsn_Ind = pos_suppression_indicator
POS_Tot_Suplr_HCPCS_Cds = pos_total_hcpcs_codes
POS_Tot_Suplr_Benes = pos_total_beneficiaries
POS_Tot_Suplr_Clms = pos_total_claims
POS_Tot_Suplr_Srvcs = pos_total_services
POS_Suplr_Sbmtd_Chrgs = pos_submitted_charge
POS_Suplr_Mdcr_Alowd_Amt = pos_medicare_allowed_amount
POS_Suplr_Mdcr_Pymt_Amt = pos_medicare_payment_amount
POS_Suplr_Mdcr_Stdzd_Pymt_Amt = pos_medicare_standardized_payment_amount
Drug_Tot_Suplr_HCPCS_Cds = drug_total_hcpcs_codes
Drug_Tot_Suplr_Benes = drug_total_beneficiaries
Drug_Tot_Suplr_Clms = drug_total_claims
Drug_Tot_Suplr_Srvcs = drug_total_services
Drug_Suplr_Sbmtd_Chrgs = drug_submitted_charge
Drug_Suplr_Mdcr_Alowd_Amt = drug_medicare_allowed_amount
Drug_Suplr_Mdcr_Pymt_Amt = drug_medicare_payment_amount
Drug_Suplr_Mdcr_Stdzd_Pymt_Amt = drug_medicare_standardized_payment_amount
"""
PROVIDER_FILES = """
Rndrng_Prvdr_Last_Org_Name = provider_last_org_name
Rndrng_Prvdr_First_Name = provider_first_name
Rndrng_Prvdr_MI = provider_middle_initial
Rndrng_Prvdr_Crdntls = provider_credentials
Rndrng_Prvdr_Ent_Cd = entity_code
Rndrng_Prvdr_St1 = provider_address_line1
Rndrng_Prvdr_St2 = provider_address_line2
Rndrng_Prvdr_City = provider_city
Rndrng_Prvdr_State_Abrvtn = provider_state
Rndrng_Prvdr_State_FIPS = provider_state_fips
Rndrng_Prvdr_Zip5 = provider_zip5
Rndrng_Prvdr_RUCA = provider_ruca
Rndrng_Prvdr_RUCA_Desc = provider_ruca_description
Rndrng_Prvdr_Cntry = provider_country
Rndrng_Prvdr_Type = provider_type
Rndrng_Prvdr_Mdcr_Prtcptg_Ind = medicare_participation_indicator
"""
#: Fixed values of the supplier and the provider file: native beneficiaries, conditions and the risk score.
BENEFICIARIES = """
Bene_Race_NatInd_Cnt = beneficiary_race_native_indian_count
Bene_CC_BH_ADHD_OthCD_V1_Pct = beneficiary_adhd_other_conduct_disorder_percent
Bene_CC_BH_Alcohol_Drug_V1_Pct = beneficiary_alcohol_drug_use_disorder_percent
Bene_CC_BH_Tobacco_V1_Pct = tobacco_pct
Bene_CC_BH_Alz_NonAlzdem_V2_Pct = beneficiary_alzheimer_non_alzheimer_dementia_percent
Bene_CC_BH_Anxiety_V1_Pct = beneficiary_anxiety_disorder_percent
Bene_CC_BH_Bipolar_V1_Pct = beneficiary_bipolar_disorder_percent
Bene_CC_BH_Mood_V2_Pct = beneficiary_mood_disorder_percent
Bene_CC_BH_Depress_V1_Pct = beneficiary_depression_percent
Bene_CC_BH_PD_V1_Pct = beneficiary_personality_disorder_percent
Bene_CC_BH_PTSD_V1_Pct = beneficiary_ptsd_percent
Bene_CC_BH_Schizo_OthPsy_V1_Pct = beneficiary_schizophrenia_other_psychotic_disorder_percent
Bene_CC_PH_Asthma_V2_Pct = asthma_pct
Bene_CC_PH_Afib_V2_Pct = beneficiary_atrial_fibrillation_percent
Bene_CC_PH_Cancer6_V2_Pct = beneficiary_cancer_percent
Bene_CC_PH_CKD_V2_Pct = beneficiary_chronic_kidney_disease_percent
Bene_CC_PH_COPD_V2_Pct = copd_pct
Bene_CC_PH_Diabetes_V2_Pct = beneficiary_diabetes_percent
Bene_CC_PH_HF_NonIHD_V2_Pct = beneficiary_heart_failure_non_ischemic_heart_disease_percent
Bene_CC_PH_Hyperlipidemia_V2_Pct = beneficiary_hyperlipidemia_percent
Bene_CC_PH_Hypertension_V2_Pct = beneficiary_hypertension_percent
Bene_CC_PH_IschemicHeart_V2_Pct = beneficiary_ischemic_heart_disease_percent
Bene_CC_PH_Osteoporosis_V2_Pct = beneficiary_osteoporosis_percent
Bene_CC_PH_Parkinson_V2_Pct = beneficiary_parkinson_disease_percent
Bene_CC_PH_Arthritis_V2_Pct = beneficiary_arthritis_percent
Bene_CC_PH_Stroke_TIA_V2_Pct = beneficiary_stroke_tia_percent
Bene_Avg_Risk_Scre = average_risk_score
"""
#: Fixed values of the drug files.
DRUG_FILES = """
Prscrbr_Last_Org_Name = prescriber_last_org_name
Prscrbr_State_Abrvtn = prescriber_state
Opioid_LA_Drug_Flag = long_acting_opioid_drug_flag
"""
NAMED = {a.lower(): b for text in (SUPPLIER_FILES, PROVIDER_FILES, BENEFICIARIES, DRUG_FILES) for a, b in (line.split(" = ") for line in text.strip().splitlines())}
